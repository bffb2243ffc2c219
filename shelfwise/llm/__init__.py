"""Training-data operators: extraction, dedup, packing, mixing, language and quality."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code, so that executors
# need no copy of this package on their Python path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
