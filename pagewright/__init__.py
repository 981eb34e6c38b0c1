"""pagewright: a Spark-native document pipeline.

Files become pages, pages get vectors, inodes and pages become search
documents, and moves, shares and deletes keep those tables right.  Every
operator is a plain function over DataFrames (or Columns) so Catalyst plans
the whole job; see README.md for the map from operators to modules.
"""

import sys as _sys

try:
    # Functions of this package that run inside Python workers (mapInPandas,
    # cogroup) are shipped by value, so executors need no copy of the package.
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

__all__ = ["session"]
