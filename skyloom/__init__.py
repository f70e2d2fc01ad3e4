"""skyloom: station time-series features, sequence preparation and evaluation as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few functions that run in Python workers travel by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
