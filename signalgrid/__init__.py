"""Radio-map and path-loss analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Ship the few Arrow kernels with the task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
