"""feedlens: user-feedback analytics as Spark DataFrame operators.

Functions and classes of this package that run inside Python workers (the
batch tagger, the list-literal parser) are pickled by value, so executors do
not need the package installed or on their path.
"""

import sys

try:  # pragma: no cover - depends on the PySpark build
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
