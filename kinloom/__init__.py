"""kinloom: record linkage and corpus analytics expressed as Spark plans."""

import sys

from pyspark import cloudpickle

# functions travel to the executors whole, so that these need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
