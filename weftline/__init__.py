"""weftline: interaction analytics and data processing on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so that workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
