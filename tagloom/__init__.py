"""Spark-native engine for (barcode, umi, index) record files and text corpora."""

import sys

from pyspark import cloudpickle

# Functions and classes of this package reach Python workers by value, so that a
# cluster needs no copy of it on the executors' import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
