"""Weftline: message archives to a queryable causal graph, on Spark DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# tasks get this package's functions by value, so that executors need no copy of it
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
