"""Spark operators for evaluating automated judges of generated answers."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# kernels travel to executors by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
