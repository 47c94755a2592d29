"""newsloom: a Spark-native engine for article feeds, events and text corpora."""

import sys

from pyspark import cloudpickle

# Python workers need no copy of the package: its functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
