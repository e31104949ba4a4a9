"""Speech-corpus preparation as Spark DataFrame transforms."""

import sys

from pyspark import cloudpickle

# The small functions that run inside Python workers travel with each task,
# so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
