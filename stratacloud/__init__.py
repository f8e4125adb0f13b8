"""Spatial analytics on Spark: moving-camera and 3-D survey data as DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a cluster needs no copy of it on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
