"""PySpark-native engine for the structure and content of e-mail at corpus scale."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions by value, so a cluster needs no copy of it on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
