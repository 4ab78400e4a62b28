"""Operators of the library. Functions that run in tasks are sent to the executors by value."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
