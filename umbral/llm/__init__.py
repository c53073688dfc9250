"""Operators for training-data pipelines; nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to Python workers by value, so a cluster
# needs no copy of the package on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
