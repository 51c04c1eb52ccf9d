"""Spark-native functional reliability analytics.

Functions of this package that run on executors are pickled by value, so a
cluster needs no copy of it beside Spark itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
