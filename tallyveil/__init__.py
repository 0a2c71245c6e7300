"""Under-reporting and small-area analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package that run in Python workers travel with the task, so the
# package only has to be installed where the driver runs.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
