"""Operators for building training data, one module each, and the queries that apply them to whole tables.

Functions of this package are pickled by value, so executors need no copy of it on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
