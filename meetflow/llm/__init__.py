"""Training-data operators: ten operators, their queries, and what they share.

Nothing outside this folder imports it.  Functions that run in Python workers
are pickled by value, so executors need no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules["meetflow"])
