"""Network-flow analytics as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with the job, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
