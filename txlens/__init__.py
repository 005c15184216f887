"""txlens: transaction-risk analytics on Spark.

Python functions that run inside tasks (``mapInPandas`` bodies, the stateful
stream processor) are shipped by value: the package is registered with
PySpark's cloudpickle, so executors run them without ``txlens`` being
installed or on their path.  Deployments that ship the package themselves
(``--py-files``, a wheel) work the same way.
"""

import sys as _sys

try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError, ValueError):  # older cloudpickle: ship the package instead
    pass
