"""furlong: race-results analytics as Spark DataFrame operators.

Every public operator takes DataFrames and returns DataFrames; nothing is
collected to the driver except small, bounded control data (a p x p Gram
matrix, a handful of category levels).
"""

import sys as _sys

__version__ = "0.1.0"

try:  # ship the two Arrow helpers by value, so executors need no install
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass
