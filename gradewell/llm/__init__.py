"""Operators for preparing training data: filters, deduplication, scoring, mixing and token files."""

import sys

from pyspark import cloudpickle

# The code of this subpackage travels with the jobs, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
