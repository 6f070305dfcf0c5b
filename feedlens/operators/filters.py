"""Row filters and projections (F1-F11). All are plain predicates that Catalyst
can push below projections; null-safe comparisons keep the reference's
treatment of missing tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens import codebook as cb
from feedlens.functions.text import is_ui_debris, not_deleted as _not_deleted, preview, substantive as _substantive


def substantive(df: DataFrame, col: str = "content",
                min_len: int = cb.MIN_CONTENT_CHARS) -> DataFrame:
    """Not null and strictly longer than ``min_len`` code points (F1)."""
    return df.filter(_substantive(col, min_len))


def not_deleted(df: DataFrame, col: str = "content") -> DataFrame:
    """Drop removed comments and empty text (F2)."""
    return df.filter(_not_deleted(col))


def min_chunk(df: DataFrame, col: str = "content", min_len: int = cb.MIN_CHUNK_CHARS) -> DataFrame:
    """Keep chunks of at least ``min_len`` code points."""
    return df.filter(F.length(col) >= F.lit(min_len))


def drop_ui_debris(df: DataFrame, col: str = "content") -> DataFrame:
    """Drop short chunks holding a UI word."""
    return df.filter(~is_ui_debris(col))


def signal(df: DataFrame, tag_col: str = "primary_tag", noise: str = cb.NOISE_TAG) -> DataFrame:
    """Rows whose tag is not the noise tag; a null tag stays."""
    return df.filter(~F.col(tag_col).eqNullSafe(F.lit(noise)))


def by_tag(df: DataFrame, tag: str, tag_col: str = "primary_tag") -> DataFrame:
    """Rows with one tag."""
    return df.filter(F.col(tag_col) == F.lit(tag))


def gold_rows(df: DataFrame, n: int | None = None) -> DataFrame:
    """Reviews that describe trying something new (F7), text whole, or cut to a display
    preview of ``n`` characters (F11; ``codebook.GOLD_PREVIEW_CHARS`` in the fixed report)."""
    return df.filter(F.col("explored_new")).select(
        "reviewId", "source", "primary_tag", preview("content", n).alias("content"))


def first_n(df: DataFrame, n: int, order_cols=("seq",)) -> DataFrame:
    """First ``n`` rows in input order (F10): a distributed top-n, not a full sort."""
    return df.orderBy(*[F.col(c).asc() for c in order_cols]).limit(n)
