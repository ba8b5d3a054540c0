"""featloom: tabular feature profiling, preparation and model checks as Spark jobs."""

import sys

from pyspark import cloudpickle

# Ship the few functions that run in Python workers with the job itself, so that
# executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
