"""Operators of a training-data pipeline over documents, conversations and embeddings.

Nothing else in the library imports this subpackage. Functions that run inside tasks are sent to
the executors by value, so a cluster needs no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
