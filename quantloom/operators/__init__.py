"""Operators over frames of bars, events and ledgers; functions of this package that run in Python workers are pickled by value, as executors have no copy of it."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
