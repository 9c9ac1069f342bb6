"""Training-data operators (one module each) and the queries that apply them.

Nothing else in the library imports this package.  Functions that run inside
Spark tasks are pickled by value, so executors need numpy, pyarrow and the
like but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
