"""Evidence analytics on Spark: DataFrames in, DataFrames out."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The Arrow helpers travel with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
