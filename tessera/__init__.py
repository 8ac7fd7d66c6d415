"""Spark-native analytics for logs of cooperative two-player word games."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the plan: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
