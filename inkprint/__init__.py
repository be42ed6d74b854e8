"""inkprint: stylometry of source-code and text corpora on Spark.

Every public function takes DataFrames and returns a DataFrame (or a fitted Spark ML model), so jobs compose
with ``df.transform``.
"""

import sys

from pyspark import cloudpickle

# Ship the few Python helpers inside the tasks that call them, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
