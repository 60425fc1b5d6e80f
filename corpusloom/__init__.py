"""Corpus and training-curve analytics expressed as Spark plans.

Functions that run in Python workers travel by value, so executors need no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
