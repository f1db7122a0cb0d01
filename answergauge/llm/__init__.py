"""Operators that prepare training data: sharding, dedup, quality, mixing, packing, archives, token files.

Nothing outside this package imports it.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
