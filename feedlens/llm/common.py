"""Shared helpers of the training-data operators: tables, scratch, Arrow text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from feedlens.session import scratch_path

# Text handled at once inside a task. A single text longer than this is still taken whole.
SLICE_BYTES = 6_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str, held: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts lineage, and a
    lost executor rereads files instead of repeating the work. The table's path goes to
    ``held``, for ``release``."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    if held is not None:
        held.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, held: list[str]) -> None:
    """Delete scratch tables that no later step reads: an operator's own, once what it
    returns has been written and depends on none of them."""
    for path in held:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    held.clear()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, null read as empty; offsets has one more
    entry than there are rows and starts at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, where, data = column.buffers()
    off = np.frombuffer(where, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    if data is None or not n:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        _, off = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of every (start, length) run, one after the other."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lens), lens)
