"""docweave: Spark jobs that audit documentation graphs, scan text and prepare text corpora."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that the
# workers need no copy of the repository on their import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
