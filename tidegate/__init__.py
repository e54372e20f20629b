"""tidegate: declarative data pipelines and large-scale data operators on PySpark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors travel with their code, so the cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
