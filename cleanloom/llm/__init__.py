"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions for executors travel with their code, so the library need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
