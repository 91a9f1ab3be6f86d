"""Vector search and corpus jobs on stock Spark: DataFrames in, DataFrames out."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers carry their code with them, so the executors need
# numpy and pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
