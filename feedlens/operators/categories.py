"""Category operators: explode mentions, normalise, classify, count.

All counts are hash aggregates with a map-side partial step, so a category
that holds a third of all mentions costs one partial row per task before the
shuffle. The alias and class tables are codebook-sized and broadcast only when
their size is known on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlens import codebook as cb
from feedlens.functions.text import normalize_category_key
from feedlens.operators.common import bounded_broadcast


def _alias_table(spark: SparkSession, aliases) -> DataFrame:
    if isinstance(aliases, DataFrame):
        return aliases
    aliases = cb.CATEGORY_ALIASES if aliases is None else aliases
    return bounded_broadcast(cb.alias_df(spark, aliases), len(aliases))


def _class_table(spark: SparkSession, perishable) -> DataFrame:
    if isinstance(perishable, DataFrame):
        return perishable
    perishable = cb.PERISHABLE if perishable is None else perishable
    return bounded_broadcast(cb.category_class_df(spark, perishable), len(perishable))


def explode_categories(tagged: DataFrame, col: str = "categories_mentioned",
                       keep: tuple[str, ...] = ("reviewId", "primary_tag", "source")) -> DataFrame:
    """One row per mention (P8): keep columns + ``pos`` + ``category_raw``.

    Null or empty lists give no rows, as the reference's loop does. The outer
    form plus a null-position filter is used on purpose: a plain ``posexplode``
    makes Catalyst infer a ``size(list) > 0`` filter below it, which copies the
    list expression - and, for lists parsed by the Python tier, runs the parser
    twice.
    """
    return (tagged.select(*keep, F.posexplode_outer(col).alias("pos", "category_raw"))
            .filter(F.col("pos").isNotNull()))


def normalize_categories(mentions: DataFrame, aliases=None,
                         raw_col: str = "category_raw") -> DataFrame:
    """Add ``category``: strip + lower case, then the alias table, default itself.

    A null item stays null; the counters drop it. (A Python ``None`` inside a
    literal list is already the text ``None`` after ``parse_list``.)
    """
    spark = mentions.sparkSession
    alias = _alias_table(spark, aliases)
    keyed = mentions.withColumn("_key", normalize_category_key(F.col(raw_col)))
    j = keyed.join(alias, keyed["_key"] == alias["raw"], "left")
    return j.withColumn("category", F.coalesce(F.col("canonical"), F.col("_key"))) \
            .drop("_key", "raw", "canonical")


def filter_class(mentions: DataFrame, mode: str | None, perishable=None,
                 col: str = "category") -> DataFrame:
    """Keep (``perishable``) or drop (``nonperishable``) members of the set.

    Uses semi / anti joins, which stay correct when the set holds nulls.
    """
    if mode is None:
        return mentions
    cls = _class_table(mentions.sparkSession, perishable).select(
        F.col("category").alias("_cls"))
    cond = mentions[col] == cls["_cls"]
    if mode == "perishable":
        return mentions.join(cls, cond, "left_semi")
    if mode == "nonperishable":
        return mentions.join(cls, cond, "left_anti")
    raise ValueError(f"unknown mode {mode!r}")


def category_counts_raw(tagged: DataFrame, tag: str,
                        col: str = "categories_mentioned") -> DataFrame:
    """Mentions per category as written, for one tag (A5): (category, mentions)."""
    m = explode_categories(tagged.filter(F.col("primary_tag") == F.lit(tag)), col,
                           keep=("reviewId",))
    return (m.filter(F.col("category_raw").isNotNull())
            .groupBy(F.col("category_raw").alias("category"))
            .agg(F.count(F.lit(1)).alias("mentions")))


def category_counts_raw_by_tag(tagged: DataFrame, tags: list[str],
                               col: str = "categories_mentioned") -> DataFrame:
    """A5 for several tags in one scan: (primary_tag, category, mentions)."""
    m = explode_categories(tagged.filter(F.col("primary_tag").isin(tags)), col,
                           keep=("primary_tag",))
    return (m.filter(F.col("category_raw").isNotNull())
            .groupBy("primary_tag", F.col("category_raw").alias("category"))
            .agg(F.count(F.lit(1)).alias("mentions")))


def category_counts(tagged: DataFrame, tag: str, mode: str | None = None,
                    aliases=None, perishable=None,
                    col: str = "categories_mentioned") -> DataFrame:
    """Normalised mentions per category for one tag, after the class filter (A6 body).

    Returns (category, mentions, reviews): ``mentions`` counts every mention,
    so two aliases in one review count twice as in the reference; ``reviews``
    is the number of distinct reviews, which the reference's caption implies.
    """
    m = explode_categories(tagged.filter(F.col("primary_tag") == F.lit(tag)), col,
                           keep=("reviewId",))
    m = normalize_categories(m, aliases).filter(F.col("category").isNotNull())
    m = filter_class(m, mode, perishable)
    return (m.groupBy("category")
            .agg(F.count(F.lit(1)).alias("mentions"),
                 F.count_distinct("reviewId").alias("reviews")))


def top_k(counts: DataFrame, k: int = cb.TOP_K_CATEGORIES, by: str = "mentions",
          name: str = "category") -> DataFrame:
    """The ``k`` largest rows, ties broken by name ascending (X3); adds ``rank``."""
    w = Window.orderBy(F.col(by).desc(), F.col(name).asc())
    return (counts.orderBy(F.col(by).desc(), F.col(name).asc()).limit(k)
            .withColumn("rank", F.row_number().over(w).cast("long")))


def category_top_k(tagged: DataFrame, tag: str, mode: str | None = None,
                   k: int = cb.TOP_K_CATEGORIES, aliases=None, perishable=None) -> DataFrame:
    """The dashboard's category panel for one tag (A6): top ``k`` normalised categories."""
    c = category_counts(tagged, tag, mode, aliases, perishable)
    return top_k(c.select("category", "mentions"), k)


def shown_mentions(top: DataFrame) -> DataFrame:
    """Sum of mentions over the shown (top-k) rows only."""
    return top.agg(F.coalesce(F.sum("mentions"), F.lit(0)).cast("long").alias("shown_mentions"))


def shown_and_all_mentions(counts: DataFrame, k: int = cb.TOP_K_CATEGORIES) -> DataFrame:
    """One row: mentions over the top ``k`` categories and over all of them.

    An ordered limit and a plain sum, one row each.
    """
    shown = shown_mentions(top_k(counts.select("category", "mentions"), k))
    return shown.join(counts.agg(F.coalesce(F.sum("mentions"), F.lit(0)).cast("long").alias("all_mentions")))


def panel_counts(tagged: DataFrame, panels: list[tuple[str, str, str | None]],
                 aliases=None, perishable=None) -> DataFrame:
    """Normalised mentions per (panel, category) for several dashboard panels
    in one pass: (panel, primary_tag, category, mentions, reviews).

    ``panels`` holds (panel name, tag, mode) with mode ``perishable``,
    ``nonperishable`` or None. The corpus is scanned and exploded once for all
    panels; mentions are aggregated per (tag, category) before the small
    broadcast join that assigns them to panels. ``mentions`` counts every
    mention (two aliases in one review count twice, as in the reference);
    ``reviews`` counts distinct reviews, which is what the dashboard's caption
    says it shows.
    """
    spark = tagged.sparkSession
    tags = sorted({t for _, t, _ in panels})
    m = explode_categories(tagged.filter(F.col("primary_tag").isin(tags)),
                           keep=("reviewId", "primary_tag"))
    m = normalize_categories(m, aliases).filter(F.col("category").isNotNull())
    cls = _class_table(spark, perishable).select(F.col("category").alias("_cls"))
    m = (m.join(cls, m["category"] == cls["_cls"], "left")
         .withColumn("_perishable", F.col("_cls").isNotNull()).drop("_cls"))
    counts = m.groupBy("primary_tag", "category", "_perishable").agg(
        F.count(F.lit(1)).alias("mentions"), F.count_distinct("reviewId").alias("reviews"))
    spec = bounded_broadcast(
        spark.createDataFrame(panels, "panel string, _tag string, _mode string"), len(panels))
    keep = (spec["_mode"].isNull()
            | ((spec["_mode"] == F.lit("perishable")) & counts["_perishable"])
            | ((spec["_mode"] == F.lit("nonperishable")) & ~counts["_perishable"]))
    j = counts.join(spec, (counts["primary_tag"] == spec["_tag"]) & keep, "inner")
    return j.select("panel", "primary_tag", "category", "mentions", "reviews")


def category_panels(tagged: DataFrame, panels: list[tuple[str, str, str | None]],
                    k: int = cb.TOP_K_CATEGORIES, aliases=None, perishable=None) -> DataFrame:
    """Top ``k`` categories of each panel (A6 for several panels at once):
    (panel, primary_tag, category, mentions, rank). The rank window runs over
    one row per (panel, category)."""
    c = panel_counts(tagged, panels, aliases, perishable)
    w = Window.partitionBy("panel").orderBy(F.col("mentions").desc(), F.col("category").asc())
    return c.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def panel_mentions(tagged: DataFrame, panels: list[tuple[str, str, str | None]],
                   k: int = cb.TOP_K_CATEGORIES, aliases=None, perishable=None) -> DataFrame:
    """Per panel: mentions behind the shown top ``k`` and all mentions."""
    # The total is a plain sum and the shown rows a grouped top-k, which keeps k rows per
    # panel and task: no panel's categories meet in one task.
    total = panel_counts(tagged, panels, aliases, perishable).groupBy("panel") \
        .agg(F.sum("mentions").alias("_all"))
    shown = category_panels(tagged, panels, k, aliases, perishable).groupBy(F.col("panel").alias("_p")) \
        .agg(F.sum("mentions").alias("_shown"))
    sums = total.join(shown, F.col("panel") == F.col("_p"), "left")
    names = bounded_broadcast(tagged.sparkSession.createDataFrame(
        [(p,) for p, _, _ in panels], "panel string"), len(panels))
    # A panel without mentions still reports zero, as the dashboard does.
    return names.join(sums, "panel", "left").select(
        "panel",
        F.coalesce("_shown", F.lit(0)).cast("long").alias("shown_mentions"),
        F.coalesce("_all", F.lit(0)).cast("long").alias("all_mentions"))
