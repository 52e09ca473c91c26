"""Stages without state, for streaming DataFrames too."""
