"""dimlark: drawing-inspection analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions go to the executors by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
