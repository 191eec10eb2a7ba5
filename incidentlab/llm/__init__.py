"""Operators of a training-data pipeline: dedup, mixing, filters, scans, tokens.

Nothing else in the package imports this folder.
"""

import sys

from pyspark import cloudpickle

# Task functions travel to the executors with their code, so that the package
# need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
