"""Quality control of environmental sensor series on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# the few functions that run inside tasks travel with the job, so executors
# need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
