"""corvane: a Spark-native engine for program corpora and the evaluation of candidates."""

from pyspark import cloudpickle as _cp

import sys as _sys

# Functions of this package travel to Python workers by value, so workers need not have it on their path.
_cp.register_pickle_by_value(_sys.modules[__name__])
