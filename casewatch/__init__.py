"""Batch and streaming jobs for monitoring court cases with Spark."""

import sys

from pyspark import cloudpickle

# Functions that Spark sends to executors carry this package's code along, so that it needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
