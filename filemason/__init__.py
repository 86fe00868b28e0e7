"""Corpus organisation on Spark: inventory, features, duplicates, rules, clusters, enrichment and plans."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers carry their code with them, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
