"""Operators of a training-data pipeline. Nothing outside this subpackage imports it.

Functions that Spark sends to Python workers travel by value, so executors need numpy, pyarrow and the
tokenizers but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
