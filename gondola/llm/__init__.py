"""Operators for preparing training text at scale.

Functions of this package are pickled by value, so that executors run them
whether or not the package is on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
