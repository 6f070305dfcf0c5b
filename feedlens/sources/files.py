"""File sources and sinks (S1, S6, S11) and the page-dump chunker.

Multi-line CSV cannot be split by Spark, so a CSV export is imported to
Parquet once (``import_reviews_csv``) and every later job reads Parquet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens import schemas
from feedlens.functions.lists import parse_list
from feedlens.functions.text import trim_u
from feedlens.operators.common import bounded_broadcast
from feedlens.operators.filters import drop_ui_debris, min_chunk
from feedlens.operators.ordering import dedup_keep_first, file_position, numbered, ranges
from feedlens.sources.threads import epoch_to_ts

# Fixed value: the tokens pandas' CSV reader reads as missing.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
               "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan",
               "null"]

_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _null_tokens(c: F.Column) -> F.Column:
    return F.when(c.isin(NULL_TOKENS), F.lit(None)).otherwise(c)


def read_reviews_csv(spark: SparkSession, path: str,
                     schema: T.StructType = schemas.TAGGED_CSV,
                     required: tuple[str, ...] = ("reviewId",)) -> DataFrame:
    """Quoted, multi-line CSV with a header (S1), typed to R1/R3.

    Columns are found by their names in the header, in any order; other columns are
    ignored, absent ones are null, and an absent column of ``required`` is an error.

    String columns map pandas' missing-value tokens to null; the float-written
    like count becomes a long; ``at`` becomes a timestamp; a category column
    holding a Python-literal list becomes ``array<string>``; ``True``/``False``
    becomes boolean. An empty file gives zero rows.
    """
    raw = (spark.read.option("header", True).option("multiLine", True)
           .option("escape", '"').option("quote", '"').option("mode", "PERMISSIVE")
           .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
           .csv(path))
    missing = [c for c in required if c in schema.names and c not in raw.columns]
    if raw.columns and missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; its header is {raw.columns}")
    cols = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`") if f.name in raw.columns else F.lit(None).cast("string")
        if isinstance(f.dataType, T.StringType):
            c = _null_tokens(c)
        if f.name == "thumbsUpCount":
            c = c.try_cast("double").try_cast("long")
        elif f.name == "at" and isinstance(f.dataType, T.StringType):
            # A date-time (store rows) or epoch seconds (forum rows), as wall-clock time.
            c = F.coalesce(F.try_to_timestamp(c).cast("timestamp_ntz"),
                           epoch_to_ts(c.try_cast("double")))
        elif f.name == "categories_mentioned" and isinstance(f.dataType, T.StringType):
            c = parse_list(c)
        elif f.name == "explored_new" and isinstance(f.dataType, T.StringType):
            low = F.lower(trim_u(c))
            c = F.when(low == "true", F.lit(True)).when(low == "false", F.lit(False))
        elif not isinstance(f.dataType, T.StringType):
            c = c.try_cast(f.dataType)
        cols.append(c.alias(f.name))
    return raw.select(*cols)


def import_reviews_csv(spark: SparkSession, path: str, out: str,
                       schema: T.StructType = schemas.TAGGED_CSV) -> DataFrame:
    """Read a CSV export once and land it as Parquet; returns the Parquet table."""
    write_table(read_reviews_csv(spark, path, schema), out, partition_by=None)
    return spark.read.parquet(out)


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: str | list[str] | None = "source") -> None:
    """Overwrite a whole table (S11), earlier sources included; ``land_table`` replaces only
    those written. Parquet by default, partitioned by source so source filters prune
    files; ``fmt='csv'`` writes a header and quotes."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "csv":
        (w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        w.format(fmt).save(path)


def landed_rows(df: DataFrame) -> DataFrame:
    """``df`` with the columns of R1, typed alike for every source and null where it has none,
    and ``seq``, its input order; other columns follow as they are."""
    def typed(f: T.StructField) -> F.Column:
        c = F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)
        return c.cast(f.dataType).alias(f.name)

    known = {f.name for f in schemas.LANDED.fields}
    return df.select(*[typed(f) for f in schemas.LANDED.fields],
                     *[F.col(f"`{c}`") for c in df.columns if c not in known])


def land_table(df: DataFrame, path: str, sources: Sequence[str] = ()) -> None:
    """Land R1 rows in a table that several sources share.

    The table is partitioned by ``source`` and only the sources in ``df`` are replaced, so
    landing one source leaves the others as they are and landing it again replaces its
    earlier rows. ``sources`` names those this landing owns: one without rows any more is
    emptied. Files are staged and moved when the whole write has succeeded.
    """
    seen = Observation()
    rows = landed_rows(df)
    if sources:
        rows = rows.observe(seen, *[F.count_if(F.col("source") == s).alias(f"n{k}") for k, s in enumerate(sources)])
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)
    gone = [s for k, s in enumerate(sources) if not seen.get[f"n{k}"]]
    jvm = df.sparkSession._jvm
    for s in gone:
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(s)
        at = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/source={name}")
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """All sources landed in ``path``: the columns of R1 and ``seq``."""
    return spark.read.schema(schemas.LANDED).parquet(path).select(schemas.LANDED.fieldNames())


def read_text_dumps(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """One row per text file: (file, value).

    Each file is one pasted page and is read whole; ``file`` is the file name,
    or the name of its partition folder when the dumps were written by Spark
    (``thread=<name>/part-*.txt``).
    """
    # By default up to 10,000 folders are listed by a task each, which costs more than the listing.
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        df = spark.read.text(path, wholetext=True, pathGlobFilter=glob)
    finally:
        spark.conf.set(_LISTING, before)
    name = F.col("_metadata.file_name")
    if "thread" in df.columns:
        name = F.col("thread").cast("string")
    return df.select(name.alias("file"), F.col("value"))


def chunk_text(dumps: DataFrame, file_col: str = "file", text_col: str = "value") -> DataFrame:
    """Split each text on exactly ``\\n\\n`` and strip each chunk.

    ``idx`` counts every chunk, before any filter; ``reviewId`` is ``{file}_{idx}``.
    """
    parts = dumps.select(F.col(file_col).alias("file"),
                         F.posexplode(F.split(F.col(text_col), "\n\n", -1)).alias("idx", "raw"))
    return parts.select(
        "file",
        F.col("idx").cast("long").alias("idx"),
        F.concat(F.col("file"), F.lit("_"), F.col("idx").cast("string")).alias("reviewId"),
        trim_u("raw").alias("content"),
    )


def chunk_large_dumps(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """``chunk_text`` for dumps of any size: the files are read line by line, in as many
    splits as Spark gives them, and no file is put together anywhere (S6, P1).

    (file, idx, reviewId, content), with the numbers that a split of the whole text on
    ``\n\n`` gives. Chunks without text are counted but not returned.

    Two lines with text that stand k line ends apart are floor(k / 2) chunks apart, so a
    chunk's number is a running sum over the lines with text. Lines are ranged and numbered
    as in ``row_index``; a line's predecessor with text is in its range, or the last of the
    ranges before, of which there is one row each.
    """
    raw = spark.read.option("lineSep", "\n").option("pathGlobFilter", glob).text(path)
    name = F.col("thread").cast("string") if "thread" in raw.columns else F.col("_metadata.file_name")
    lines = file_position(raw.select(name.alias("file"), "value"), "at")
    ranged, n = ranges(lines.withColumn("path", F.col("at.file")), "at")
    ranged = numbered(ranged, n, "g")
    full = F.when(F.col("value") != "", F.struct("g", "path"))
    every, upto = Window.orderBy("_b"), Window.unboundedPreceding
    lasts = ranged.groupBy("_b").agg(F.max(full).alias("last"))
    carry = bounded_broadcast(lasts.select("_b", F.last("last", ignorenulls=True).over(
        every.rowsBetween(upto, -1)).alias("carry")), n)
    inside = Window.partitionBy("_b").orderBy("_m")
    found = ranged.withColumn("prev", F.last(full, ignorenulls=True).over(inside.rowsBetween(upto, -1))) \
        .join(carry, "_b").where(F.col("value") != "").withColumn("prev", F.coalesce("prev", "carry")).drop("carry")
    step = F.when(F.col("prev.path") == F.col("path"), F.floor((F.col("g") - F.col("prev.g")) / 2)).otherwise(F.lit(0))
    found = found.withColumn("step", step.cast("long")).withColumn("in", F.sum("step").over(inside.rowsBetween(upto, 0)))
    sums = found.groupBy("_b").agg(F.sum("step").alias("n"))
    before = bounded_broadcast(sums.select("_b", F.coalesce(F.sum("n").over(
        every.rowsBetween(upto, -1)), F.lit(0)).alias("before")), n)
    placed = found.join(before, "_b").select("file", "path", "g", "value", (F.col("in") + F.col("before")).alias("d"))
    starts = ranged.groupBy("path").agg(F.min("g").alias("start"))
    firsts = placed.groupBy("path").agg(F.min(F.struct("g", "d")).alias("first")).join(starts, "path") \
        .select("path", (F.floor((F.col("first.g") - F.col("start")) / 2) - F.col("first.d")).cast("long").alias("shift"))
    chunks = placed.join(firsts, "path").withColumn("idx", F.col("d") + F.col("shift")) \
        .groupBy("file", "path", "idx").agg(F.array_sort(F.collect_list(F.struct("g", "value"))).alias("lines"))
    content = trim_u(F.array_join(F.col("lines.value"), "\n"))
    return chunks.select("file", "idx", F.concat(F.col("file"), F.lit("_"), F.col("idx").cast("string")).alias("reviewId"),
                         content.alias("content")).where(F.col("content") != "")


def clean_chunks(chunks: DataFrame) -> DataFrame:
    """Keep chunks of 25+ characters that are not short UI debris."""
    return drop_ui_debris(min_chunk(chunks))


def land_dumps(dumps: DataFrame, source: str = "reddit_manual") -> DataFrame:
    """Pasted pages to R1: chunk, clean, keep the first copy of each text in
    (file name, chunk) order."""
    kept = clean_chunks(chunk_text(dumps))
    first = dedup_keep_first(kept, "content", ("file", "idx"))
    return first.select(
        "reviewId", "content",
        F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("long").alias("thumbsUpCount"),
        F.lit(None).cast("timestamp_ntz").alias("at"),
        F.lit(source).alias("source"),
        F.col("file").alias("thread"),
        "idx",
    )
