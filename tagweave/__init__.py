"""Label-efficient data curation as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Kernels run inside executor tasks. Shipping them by value lets a plain
# `spark-submit driver.py` work without installing the package on every worker.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
