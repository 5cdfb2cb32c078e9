"""A SQL and data-processing engine on PySpark, SQLite-flavoured where dialects differ."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel by value: nothing needs to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
