"""Recommender-data analytics on Spark: jagged features, lookups, metrics, remapping."""

import sys

from pyspark import cloudpickle

# functions sent to executors are pickled by value: workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
