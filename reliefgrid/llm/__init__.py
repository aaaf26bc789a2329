"""Operators for training-data pipelines; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# helpers of the operators reach the Python workers with their tasks
cloudpickle.register_pickle_by_value(sys.modules[__name__])
