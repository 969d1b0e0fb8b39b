"""Operators of a training-data pipeline.  Nothing else of the package imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors with the tasks that call them, so that the
# package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
