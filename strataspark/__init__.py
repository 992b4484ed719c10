"""Repository-architecture analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so an executor needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
