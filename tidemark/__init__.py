"""tidemark: a PySpark-native engine for daily panels, point-in-time joins and event studies."""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need no copy of this package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
