"""Order-dependent operators: dense row index, keep-first dedup, exact sample.

None of these relies on partition order, and none sends a whole table or a
whole group through one task:

* ``file_position`` names each row's place in the files it was read from, which is the
  same however the files are split into tasks.
* ``row_index`` ranges and sorts the rows once, and adds the sizes of the
  ranges before (one row per range) to each row's place in its own;
  ``running_total`` does the same with the sums of a column.
* ``dedup_keep_first`` finds each content's first position with a partial
  aggregate (one row per task and content before the shuffle), then keeps the
  matching rows with a semi join on (content hash, position), whose keys are
  unique, so a content copied a billion times is no hotter than any other.
* ``sample_exact`` is a distributed top-n on a seeded hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens import codebook as cb
from feedlens.operators.common import bounded_broadcast
from feedlens.session import scratch_path


POSITION = T.StructType([T.StructField("file", T.StringType()), T.StructField("block", T.LongType()),
                         T.StructField("row", T.LongType())])


def file_position(df: DataFrame, col: str = "position") -> DataFrame:
    """Add ``col``, struct<file, block, row>: where each row stands in the input files.

    ``df`` is read from files, by steps that keep rows. Files come in the order of their
    paths; within a Parquet file rows by their number, within other files by the block they
    start in and their place there. Sorting by it gives the same order for any split planning.
    """
    known = df.select("_metadata").schema["_metadata"].dataType.names
    block, row = F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    if "row_index" in known:
        block, row = F.lit(0).cast("long"), F.col("_metadata.row_index")
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), block.alias("block"), row.alias("row"))
                     .cast(POSITION).alias(col))


def input_seq(df: DataFrame, col: str = "seq") -> DataFrame:
    """Add ``col``, the dense 0-based position of each row in its input files; a column of
    that name stands."""
    if col in df.columns:
        return df
    return row_index(file_position(df, "_position"), "_position", col).drop("_position")


def ranges(df: DataFrame, order_col: str | Sequence[str], buckets: int | None = None) -> tuple[DataFrame, int]:
    """``df`` in sorted ranges, written with ``_m``, the place in its range below the range's
    number, and ``_b``, that number; and how many ranges there are at most."""
    spark = df.sparkSession
    cols = [order_col] if isinstance(order_col, str) else list(order_col)
    n = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = scratch_path(spark, "row-index")
    df.repartitionByRange(n, *cols).sortWithinPartitions(*cols) \
        .withColumn("_m", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_m", T.LongType())])).parquet(path)
    return rows.withColumn("_b", F.shiftright("_m", 33)), n


def row_index(df: DataFrame, order_col: str | Sequence[str], idx_col: str = "idx",
              buckets: int | None = None) -> DataFrame:
    """Add a dense 0-based position in the order of ``order_col`` (one column or several,
    of any sortable type; nulls first, equal keys in any fixed order).

    The rows are ranged and sorted once and written to the shared scratch folder with
    their place in their range; the ranges' sizes, one row per range, turn the places
    into positions. Texts move once, and no window or range holds more than its share.
    """
    return numbered(*ranges(df, order_col, buckets), idx_col).drop("_m", "_b")


def numbered(rows: DataFrame, n: int, idx_col: str) -> DataFrame:
    """``ranges`` with the position of each row over all ranges."""
    sizes = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bounded_broadcast(sizes.select(
        "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")), n)
    return (rows.join(offsets, "_b", "inner")
            .withColumn(idx_col, F.col("_off") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_off"))


def running_total(df: DataFrame, order_col: str | Sequence[str], value_col: str, total_col: str = "total",
                  buckets: int | None = None) -> DataFrame:
    """Add the sum of ``value_col`` over all rows up to and with this one, in the order of
    ``order_col`` (equal keys in any fixed order; a null adds nothing).

    Sums run within sorted ranges, one window each; the ranges' own sums, one row per
    range, carry the total from one range to the next.
    """
    rows, n = ranges(df, order_col, buckets)
    value = F.coalesce(F.col(value_col), F.lit(0))
    sums = rows.groupBy("_b").agg(F.sum(value).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bounded_broadcast(sums.select(
        "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")), n)
    inside = Window.partitionBy("_b").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    return (rows.withColumn(total_col, F.sum(value).over(inside)).join(offsets, "_b", "inner")
            .withColumn(total_col, F.col("_off") + F.col(total_col)).drop("_m", "_b", "_off"))


def content_hash(col: str = "content") -> F.Column:
    return F.sha2(F.col(col), 256)


def dedup_keep_first(df: DataFrame, content_col: str = "content",
                     order_cols: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Keep the first row of every exact content, in input order.

    ``order_cols`` must identify a row. Null content is one group, as in pandas.
    """
    h = F.coalesce(content_hash(content_col), F.lit("<null>"))
    keyed = df.withColumn("_h", h)
    if len(order_cols) == 1:
        firsts = keyed.groupBy("_h").agg(F.min(order_cols[0]).alias("_first"))
        cond = [keyed["_h"] == firsts["_h"], keyed[order_cols[0]] == firsts["_first"]]
    else:
        firsts = keyed.groupBy("_h").agg(F.min(F.struct(*order_cols)).alias("_first"))
        cond = [keyed["_h"] == firsts["_h"]] + [
            keyed[c] == firsts["_first"][c] for c in order_cols]
    return keyed.join(firsts, cond, "left_semi").drop("_h")


def sample_exact(df: DataFrame, n: int = cb.SAMPLE_SIZE, seed: int = cb.SAMPLE_SEED,
                 id_col: str = "reviewId") -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement, the same for any
    partitioning: the ``n`` smallest md5(seed:id), ties by id (X5)."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast(T.StringType())))
    return df.orderBy(key.asc(), F.col(id_col).asc()).limit(n)
