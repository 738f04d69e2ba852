"""Market-style time-series analytics as DataFrame-to-DataFrame operators on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so only the driver needs this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
