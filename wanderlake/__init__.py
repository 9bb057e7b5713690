"""wanderlake: random-walk analytics and corpus preparation as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# What runs in tasks travels with them: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
