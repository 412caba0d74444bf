"""Column functions and the two vectorised helpers, which are pickled by value: executors need no copy of the package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
