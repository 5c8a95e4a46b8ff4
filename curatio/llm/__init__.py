"""Operators for training-data pipelines (one module each) and their queries.

Nothing else in the library imports this subpackage. ``queries`` maps the
registered names to thin builders over the driver's tables; the operators keep
their own interfaces (any DataFrame, named key and text columns).
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this subpackage go to the Python workers by value: a worker that cannot import
# the package (a driver started from another folder) runs them all the same.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
