"""Operators for preparing training text; nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers whole, so the workers need no copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
