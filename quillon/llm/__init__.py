"""Operators for preparing language-model training text.

Nothing outside this subpackage imports it. Functions sent to executors are
pickled by value, so that workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
