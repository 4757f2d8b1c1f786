"""Spark-native event-graph retrieval engine.

Functions of this package are sent to the executors by value, so that these need
not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
