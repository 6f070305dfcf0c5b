"""Shared plumbing for operators: size-checked broadcast of dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A dimension table is broadcast only when its row count is known on the driver
# (it was built from a Python list) and below this bound. Anything else is left
# to the planner: AQE turns a join into a broadcast at run time only when the
# measured shuffle size is below spark.sql.adaptive.autoBroadcastJoinThreshold.
MAX_BROADCAST_ROWS = 100_000


def bounded_broadcast(df: DataFrame, known_rows: int | None) -> DataFrame:
    """Broadcast hint for a side whose size is proven small; no hint otherwise."""
    if known_rows is not None and known_rows <= MAX_BROADCAST_ROWS:
        return F.broadcast(df)
    return df
