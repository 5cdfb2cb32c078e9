"""Training-data operators: tokenising, filtering, deduplicating and scoring corpora.

Nothing else in the library imports this subpackage. Its worker functions are pickled
by value, so executors need only numpy, pyarrow and tiktoken, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
