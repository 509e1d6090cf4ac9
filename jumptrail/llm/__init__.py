"""Operators of a training-data pipeline. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their modules, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
