"""A PySpark-native engine for keyed, partitioned logs.

Python kernels are shipped to the executors by value, so that a cluster needs no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
