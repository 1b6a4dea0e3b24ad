"""Supply-chain risk analytics on Spark."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value, so these need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
