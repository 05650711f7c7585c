"""Operators of a training-data pipeline, each with its registered query.

Nothing else in the library imports this package. Its functions are shipped to
Python workers by value, so executors need no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
