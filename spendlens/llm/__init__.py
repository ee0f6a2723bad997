"""Operators for building training corpora, each over whole tables and whole texts.

Nothing else in the library imports this subpackage.  Functions that run in
Python workers, and the classes of what they are given (``common.Shared``), are shipped by
value, so that workers need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
