"""Operators of a training-data pipeline; the registered queries are in ``queries``.

Functions of this package travel to the executors by value, so the package need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
