"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to Python workers by value: executors need not have it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
