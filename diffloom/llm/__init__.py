"""Training-data operators: deduplication, filtering, mixing and archive tools.

Nothing outside this subpackage imports it, so it can be removed as a whole.
Functions that executors run travel by value: workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
