"""Planning and checking moves of imaging-archive projects with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Ship the package's functions with the tasks, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
