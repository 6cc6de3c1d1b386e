"""Photo and video collections as tables: sharing contracts, deduplication, enrichment and verification on Spark.

The package's functions are shipped to Python workers by value, so a worker needs no copy of it on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
