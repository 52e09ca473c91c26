"""Per-row stages as one transformation; they hold no state, so a stream needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strandlake.operators import expression


def effect_rows(precomputed: DataFrame) -> DataFrame:
    """Imported statuses, then canonical effects, of a batch or a stream of precomputed rows."""
    return expression.canonical_effects(expression.imported_statuses(precomputed))


def start(stream: DataFrame, path: str, checkpoint: str):
    """Appends effect rows to a Parquet folder, exactly once."""
    return effect_rows(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
