"""Entity-pair analytics as Spark plans.

Functions that run on executors are shipped by value, so workers need no copy
of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
