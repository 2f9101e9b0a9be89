"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Functions of it that run on executors travel by value, so
executors need no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
