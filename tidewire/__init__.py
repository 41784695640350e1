"""Market-news analytics as lazy Spark plans.

Every operator takes and returns ``DataFrame`` objects. See README.md for the map from the
survey's operator ids to functions.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers by value, so these need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
