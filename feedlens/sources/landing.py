"""Landing jobs: store exports, uploads and pasted text into R1.

Network pulls are not part of this engine; each job starts where the
reference's data logic starts, at rows already landed as files or tables.
Every output has the R1 columns; an optional ``seq`` column carries the input
order through when the input has one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens import codebook as cb
from feedlens.functions.text import substantive, trim_u
from feedlens.operators.ordering import POSITION, row_index, running_total

R1_COLS = ["reviewId", "content", "score", "thumbsUpCount", "at", "source", "thread"]


def _keep_seq(df: DataFrame) -> list:
    return ["seq"] if "seq" in df.columns else []


def land_play(df: DataFrame, source: str = "play_store") -> DataFrame:
    """Project the five export columns, stamp the source, keep substantive text."""
    return df.select(
        F.col("reviewId").cast("string").alias("reviewId"),
        F.col("content"),
        F.col("score").cast("double").alias("score"),
        F.col("thumbsUpCount").cast("long").alias("thumbsUpCount"),
        F.col("at"),
        F.lit(source).alias("source"),
        F.lit(None).cast("string").alias("thread"),
        *_keep_seq(df),
    ).filter(substantive("content"))


def land_appstore(df: DataFrame, limit: int | None = None, order_cols=("seq",),
                  source: str = "app_store") -> DataFrame:
    """App Store export to R1 (S3): ``ios_`` ids, rating -> score, no likes.

    ``limit`` reproduces a capped pull: the first ``limit`` rows in feed order,
    with the length filter applied after the cap, as the reference does.
    """
    if limit is not None:
        df = df.orderBy(*order_cols).limit(limit)
    return df.select(
        F.concat(F.lit("ios_"), F.col("id").cast("string")).alias("reviewId"),
        F.col("content"),
        F.col("rating").cast("double").alias("score"),
        F.lit(None).cast("long").alias("thumbsUpCount"),
        F.col("date").alias("at"),
        F.lit(source).alias("source"),
        F.lit(None).cast("string").alias("thread"),
        *_keep_seq(df),
    ).filter(substantive("content"))


def ingest_text_column(df: DataFrame, col: str, order_col: str = "seq",
                       cap: int | None = None, prefix: str = "up_",
                       source: str = "upload") -> DataFrame:
    """Any table and a chosen text column.

    Ids ``up_{i}`` use the 0-based input position *before* filtering; text is
    cast to string with a missing value read as ``nan`` (so it fails the
    length floor); ``cap`` keeps the first rows after the filter.
    """
    indexed = row_index(df.select(F.col(order_col), F.col(col).alias("_text")), order_col)
    out = indexed.select(
        F.concat(F.lit(prefix), F.col("idx").cast("string")).alias("reviewId"),
        F.coalesce(F.col("_text").cast("string"), F.lit("nan")).alias("content"),
        F.lit(source).alias("source"),
        F.col("idx"),
    ).filter(substantive("content"))
    if cap is not None:
        out = out.orderBy("idx").limit(cap)
    return out


def ingest_lines(df: DataFrame, text_col: str, key_col: str, cap: int | None = None,
                 prefix: str = "own_", source: str = "paste") -> DataFrame:
    """Pasted text, one review per line.

    Each text is split on newlines, each line stripped, lines of more than 20
    characters kept, and the kept lines numbered ``own_{i}`` *after* the
    filter. The work is row-local: the filter runs on the line array of each
    text before it is exploded, so no window or shuffle is needed.
    """
    lines = F.transform(F.split(F.col(text_col), "\n", -1), lambda x: trim_u(x))
    kept = F.filter(lines, lambda x: F.length(x) > F.lit(cb.MIN_CONTENT_CHARS))
    if cap is not None:
        kept = F.slice(kept, 1, cap)
    exploded = df.select(F.col(key_col), F.posexplode(kept).alias("line_no", "content"))
    return exploded.select(
        F.col(key_col),
        F.concat(F.lit(prefix), F.col("line_no").cast("string")).alias("reviewId"),
        "content",
        F.lit(source).alias("source"),
        F.col("line_no").cast("long").alias("line_no"),
    )


def newest_reviews(df: DataFrame, n: int, at_col: str = "at",
                   id_col: str = "reviewId") -> DataFrame:
    """The ``n`` newest rows (ties by id), then not-null and length > 20.

    An ordered limit is a distributed top-n: each task keeps ``n`` rows.
    """
    top = df.orderBy(F.col(at_col).desc_nulls_last(), F.col(id_col).asc()).limit(n)
    return top.filter(substantive("content"))


def union_sources(dfs: list[DataFrame]) -> DataFrame:
    """Stack sources in order (S10); columns missing from one source become null.

    ``source_no`` and ``position`` carry the stack order: the table's place in the list,
    and within it the order of ``seq`` (by source, where one table holds several), or else
    of ``position``, the place in its files (``file_position``), or else of the scan.
    Neither is null: a null ``seq`` stands before all others.
    """
    def placed(k: int, df: DataFrame) -> DataFrame:
        none = F.lit(None)
        seq = F.col("seq").cast("long") if "seq" in df.columns else none.cast("long")
        of = F.col("source").cast("string") if "source" in df.columns else none.cast("string")
        scan = F.lit(0).cast("long") if "seq" in df.columns else F.monotonically_increasing_id()
        place = F.col("position") if "position" in df.columns else F.struct(
            F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), scan.alias("row")).cast(POSITION)
        return df.withColumn("source_no", F.lit(k)).withColumn("position", F.struct(
            F.coalesce(F.when(seq.isNotNull(), of), F.lit("")).alias("source"),
            F.coalesce(seq, F.lit(-(1 << 63))).alias("seq"), place.alias("place")))

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                  [placed(k, df) for k, df in enumerate(dfs)])


# Rows of an ordered limit that one task may hold and sort.
FEW_ROWS = 100_000


def _first_rows(feed: DataFrame, order_cols: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in the order of ``order_cols`` (nulls first, equal keys in any order).

    The key of the last one is found over the keys alone, so only rows up to it bring their
    other columns.
    """
    key = F.struct(*order_cols)
    keys = feed.select(key.alias("_key"))
    if n <= FEW_ROWS:
        last = keys.orderBy("_key").limit(n).agg(F.max("_key").alias("_last"))
        return feed.where(key <= last.scalar()).orderBy(*order_cols).limit(n)
    last = row_index(keys, "_key", "_place").where(F.col("_place") < n).agg(F.max("_key").alias("_last"))
    return row_index(feed.where(key <= last.scalar()), order_cols, "_place").where(F.col("_place") < n).drop("_place")


def pull_pages(feed: DataFrame, order_cols: tuple[str, ...] = ("seq",), page_rows: int = 200,
               target: int = 3_000, page_col: str | None = None) -> DataFrame:
    """The rows a paged pull keeps (X4): whole pages, up to and with the first page that
    brings the rows pulled to ``target``, or up to an empty page.

    Pages are ``page_rows`` rows in feed order, or the values of ``page_col`` (numbered from
    0; a number without rows is an empty page). Pages of ``page_rows`` rows need no count: what
    stays is the target, rounded up to whole pages, in first rows. With ``page_col`` the page
    where the pull stops is where the running total of page sizes first crosses the target.
    Each page before it has rows, so it is among the ``target`` first: only their sizes are
    added up, and one number reaches the driver.
    """
    if page_col is None:                    # pages of one size: the target is reached by the same row in any feed
        return _first_rows(feed, order_cols, max(0, -(-target // page_rows)) * page_rows)
    pages = feed.withColumn("_page", F.col(page_col).cast("long"))
    sizes = pages.where(F.col("_page").between(0, target - 1)).groupBy("_page").agg(F.count(F.lit(1)).alias("rows"))
    at = running_total(row_index(sizes, "_page", "_nth"), "_page", "rows")
    stop = at.where((F.col("total") >= target) | (F.col("_nth") < F.col("_page"))).agg(
        F.min(F.when(F.col("_nth") < F.col("_page"), F.col("_nth")).otherwise(F.col("_page") + 1)).alias("at")).first()["at"]
    kept = pages.where(F.col("_page") >= 0)
    if stop is None:                                   # the feed ends first, if no page is missing
        stop = target
    return kept.where(F.col("_page") < stop).drop("_page")
