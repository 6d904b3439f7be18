"""textloom: a Spark-native engine for text embedding and corpus preparation."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: what runs there travels with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
