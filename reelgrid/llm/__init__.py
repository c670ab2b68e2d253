"""Training-data operators: dedup, extraction, language, packing, sharding, mixing, chat."""

import sys

from pyspark import cloudpickle

# Python workers need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
