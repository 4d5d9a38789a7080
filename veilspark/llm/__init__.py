"""Operators for preparing training data, and the queries that apply them.

Nothing else in the library imports this subpackage. Its task functions travel
to the executors by value, so the workers need no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
