"""glossmill: evaluation, registry and run-history analytics for translation work, on Spark.

Every public function takes and returns DataFrames or Columns and runs on the caller's session.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the query, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
