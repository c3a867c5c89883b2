"""authornet: author-network analytics as Spark DataFrame jobs."""

import sys as _sys

try:  # ship our Python functions (e.g. scorers for mapInPandas) by value,
    # so executors need not have the package installed
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without the hook
    pass
