"""Spark-native analytics over documents, page layout and text."""

import sys

from pyspark import cloudpickle

# Functions that run in executors travel with their code, so executors needn't have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
