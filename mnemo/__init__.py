"""Agent-memory analytics on Spark: typed event logs folded into tables, tenant-bound reads, ranked recall, timers."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a cluster needs no copy of it on its Python path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
