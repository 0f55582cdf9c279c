"""Operators for the preparation of training text, and the queries that apply them.

Their Python functions travel to the executors by value, so a cluster needs no copy of this package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
