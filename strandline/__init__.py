"""Spark-native lake profiling: inventory, inference, table metadata, load and validation."""

import sys

from pyspark import cloudpickle

from .workspace import build_session, configure

# Functions that run on executors travel by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "configure"]
