"""prizelens: PySpark operators for prize-money and attention data."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors by value, so a job also runs
# where the package is installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
