"""Point-in-time panel research on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code, so that executors needn't have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
