"""Aggregations over the tagged corpus.

Every aggregate here is a hash aggregate with a partial (map-side) step, so a
tag or source holding a third of all rows costs one partial row per task
before the shuffle. Shares are computed with windows over the *aggregated*
rows (one per tag / source pair), never over raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlens import codebook as cb
from feedlens.operators.filters import signal


def _share(num, den) -> F.Column:
    """Exact IEEE division of two counts (no rounding: every engine agrees on it)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def tag_counts(df: DataFrame, tag_col: str = "primary_tag") -> DataFrame:
    """Rows per tag, largest first, ties by name (A1). Null tags are dropped."""
    return (df.filter(F.col(tag_col).isNotNull())
            .groupBy(tag_col).agg(F.count(F.lit(1)).alias("reviews"))
            .orderBy(F.col("reviews").desc(), F.col(tag_col).asc()))


def signal_tag_counts(df: DataFrame, noise: str = cb.NOISE_TAG) -> DataFrame:
    """A1 without the noise tag (A2)."""
    return tag_counts(signal(df, noise=noise))


def score_distribution(df: DataFrame, col: str = "score") -> DataFrame:
    """Rows per score, by score; null scores dropped (A3)."""
    return (df.filter(F.col(col).isNotNull())
            .groupBy(F.col(col).cast("double").alias("score"))
            .agg(F.count(F.lit(1)).alias("reviews")).orderBy("score"))


def tag_by_source(df: DataFrame, sources: list[str] | None = None,
                  tag_col: str = "primary_tag", source_col: str = "source") -> DataFrame:
    """Tag x source table, zero-filled; rows with a null tag or source dropped (A4).

    Pass ``sources`` when known: Spark then skips the job that finds them.
    """
    base = df.filter(F.col(tag_col).isNotNull() & F.col(source_col).isNotNull())
    g = base.groupBy(tag_col)
    p = g.pivot(source_col, sources) if sources is not None else g.pivot(source_col)
    out = p.agg(F.count(F.lit(1)))
    value_cols = [c for c in out.columns if c != tag_col]
    return out.na.fill(0, value_cols).orderBy(tag_col)


def noise_split(df: DataFrame, tag_col: str = "primary_tag", noise: str = cb.NOISE_TAG) -> DataFrame:
    """Total, noise and signal rows in one pass."""
    is_noise = F.col(tag_col).eqNullSafe(F.lit(noise))
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.count_if(is_noise).alias("noise"),
                  F.count_if(~is_noise).alias("signal"))


def signal_share(df: DataFrame, tag_col: str = "primary_tag", noise: str = cb.NOISE_TAG) -> DataFrame:
    """Each tag's share of the non-noise rows (A9): (tag, reviews, share)."""
    c = signal_tag_counts(df, noise)
    w = Window.partitionBy()  # over one row per tag only
    return c.withColumn("share", _share(F.col("reviews"), F.sum("reviews").over(w)))


def source_share_of_tag(df: DataFrame, tag_col: str = "primary_tag",
                        source_col: str = "source") -> DataFrame:
    """Per tag, the share coming from each source, next to that source's share of
    the corpus (A10): (tag, source, reviews, share_of_tag, share_of_corpus)."""
    base = df.filter(F.col(tag_col).isNotNull() & F.col(source_col).isNotNull())
    pair = base.groupBy(tag_col, source_col).agg(F.count(F.lit(1)).alias("reviews"))
    by_tag = Window.partitionBy(tag_col)
    by_source = Window.partitionBy(source_col)
    everything = Window.partitionBy()
    return (pair
            .withColumn("share_of_tag", _share(F.col("reviews"), F.sum("reviews").over(by_tag)))
            .withColumn("share_of_corpus",
                        _share(F.sum("reviews").over(by_source), F.sum("reviews").over(everything))))


def substantive_yield(df: DataFrame, group_col: str, col: str = "content",
                      min_len: int = cb.MIN_CONTENT_CHARS) -> DataFrame:
    """Rows pulled and rows with substantive text, per app."""
    c = F.col(col)
    return df.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("pulled"),
        F.count_if(c.isNotNull() & (F.length(c) > F.lit(min_len))).alias("substantive"))


def corpus_size(df: DataFrame, source_col: str = "source") -> DataFrame:
    """Reviews per source."""
    return df.groupBy(source_col).agg(F.count(F.lit(1)).alias("reviews"))
