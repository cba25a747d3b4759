"""lexiflow: corpus discovery and correspondence analytics as Spark DataFrame operators.

Operators are functions ``DataFrame -> DataFrame`` built from Spark SQL expressions, joins,
aggregates and windows. Most are lazy; those that iterate (graph measures, trees) or read
an intermediate table several times run jobs when they are called and write it to the
shared folder. The driver gets scalars, one row per partition, file list or learned group,
or a model whose size a parameter bounds; never documents, terms or links of the corpus.
"""

import sys as _sys

from lexiflow.session import get_spark, checkpoint_dir  # noqa: F401

# Functions of this package that run inside Python workers (mapInPandas steps) are
# shipped with the task by value, so executors need no installed copy of the package.
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # older cloudpickle: executors then need the package on their path
    pass

__all__ = ["get_spark", "checkpoint_dir"]
