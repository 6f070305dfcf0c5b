"""Human validation of machine tags.

The blind copy and the answer key are small by design (a sample); the
agreement operators work on any number of coded rows: the join is on a unique
review id, and every figure is one aggregate pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens import codebook as cb
from feedlens.functions.text import normalize_label, preview
from feedlens.operators.ordering import sample_exact


def validation_sample(tagged: DataFrame, n: int = cb.SAMPLE_SIZE,
                      seed: int = cb.SAMPLE_SEED) -> DataFrame:
    """The seeded sample of ``n`` tagged rows."""
    return sample_exact(tagged, n, seed, "reviewId")


def blind_copy(sample: DataFrame) -> DataFrame:
    """(reviewId, content, your_tag='') for the human coder (V1)."""
    return sample.select("reviewId", "content", F.lit("").alias("your_tag"))


def answer_key(sample: DataFrame) -> DataFrame:
    """(reviewId, primary_tag), kept apart from the blind copy (V2)."""
    return sample.select("reviewId", "primary_tag")


def coded(blind: DataFrame, key: DataFrame) -> DataFrame:
    """Join the coded blind copy to the key (J2) and clean the human tag.

    Adds ``is_junk`` and ``agrees``, both null-safe (N2): a missing human tag
    is not JUNK and does not agree, so it counts as a disagreement.
    """
    j = blind.join(key, "reviewId", "inner")
    t = normalize_label("your_tag")
    return (j.withColumn("your_tag", t)
            .withColumn("is_junk", F.col("your_tag").eqNullSafe(F.lit(cb.HUMAN_ONLY_TAG)))
            .withColumn("agrees", F.col("your_tag").eqNullSafe(F.col("primary_tag"))))


def agreement(coded_rows: DataFrame) -> DataFrame:
    """JUNK rows, agreeing rows, scored rows and their ratio.

    The ratio is null when nothing was scored.
    """
    scored = ~F.col("is_junk")
    return coded_rows.agg(
        F.count_if(F.col("is_junk")).alias("junk_rows"),
        F.count_if(scored & F.col("agrees")).alias("agree"),
        F.count_if(scored).alias("scored"),
    ).withColumn("agreement", F.try_divide(F.col("agree").cast("double"),
                                           F.col("scored").cast("double")))


def disagreements(coded_rows: DataFrame,
                  n: int | None = None) -> DataFrame:
    """Scored rows where human and machine differ (V4), text whole, or cut to a display
    preview of ``n`` characters (``codebook.DISAGREEMENT_PREVIEW_CHARS`` in the fixed report)."""
    return coded_rows.filter(~F.col("is_junk") & ~F.col("agrees")).select(
        "reviewId", "your_tag", "primary_tag", preview("content", n).alias("content"))


def confusion(coded_rows: DataFrame) -> DataFrame:
    """Scored rows per (human tag, machine tag) pair (V5)."""
    return (coded_rows.filter(~F.col("is_junk"))
            .groupBy("your_tag", "primary_tag").agg(F.count(F.lit(1)).alias("reviews")))
