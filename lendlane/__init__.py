"""lendlane: loan-eligibility analytics as Spark operators over whole tables."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so the
# executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
