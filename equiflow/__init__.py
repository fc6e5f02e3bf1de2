"""Network-equilibrium analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# functions travel to executors with their code, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
