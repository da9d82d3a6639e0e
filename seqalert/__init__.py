"""Analytics over ordered token sequences, written as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors inside the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
