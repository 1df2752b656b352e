"""A Spark-native engine for catalog search, ranking, dialogue state and offline evaluation."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: a cluster needs no copy of it on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
