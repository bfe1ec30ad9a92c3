"""Operators for a training-data pipeline. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Python workers get these functions themselves, so executors need no copy of the package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
