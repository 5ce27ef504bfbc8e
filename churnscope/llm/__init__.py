"""Operators of a training-data pipeline.  Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# functions go to the executors by value, so that those need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
