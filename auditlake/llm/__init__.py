"""Operators for preparing training text: filtering, deduplication, mixing, tokenising.

Nothing else in the library imports this package. Its functions run in executors' Python workers, so
they are pickled by value: a cluster needs no copy of the package on its machines.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
