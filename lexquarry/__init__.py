"""lexquarry: document-corpus analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the plan, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
