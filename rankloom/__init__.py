"""Learning-to-rank and two-stage retrieval on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Ship the helpers that run inside tasks with the job itself, so that
# executors need no copy of this package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
