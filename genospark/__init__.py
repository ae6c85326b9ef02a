"""genospark: statistical genomics and corpus preparation as Spark plans.

Functions of this package travel to Python workers by value, so executors need
no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
