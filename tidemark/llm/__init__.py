"""Operators for preparing training text: every operator works on a DataFrame of documents.

Functions of this package travel to the executors by value, so a cluster needs no copy of the library on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
