"""Curate image and video-frame datasets with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package reach the Python workers by value, so executors
# need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
