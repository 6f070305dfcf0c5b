"""Fill-in-the-middle: documents cut at unit borders and rearranged around markers.

One ``fullmatch`` of ``(unit)*`` keeps every repetition of its group, so ``ends(1)`` is
the list of all unit borders: its length is the number of units, and the two cuts are two
of its entries. Which units are cut, and in which form, comes from the digits of a sha256
of the document's id, so a rerun cuts alike. Only the texts go to Python, and three
numbers come back; the output is put together in the JVM.

Defined cases: a null text counts as empty, an empty text is plain with no units; a text
that holds a marker is plain, so ``restore`` is always exact; a null doc_id is hashed as
the seed alone; rows that repeat a doc_id are cut by the same digits, so equal rows come
out alike; a text that the units do not cover is one unit; texts of any length are taken
whole, at about 40 bytes a unit while one is matched; an empty table gives an empty
result; all columns are kept in ``_row``.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Blanks belong to the word after them; only blanks at the end are a unit of their own. The
# quantifiers never give back, so a match takes one pass.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
MARKERS = ("<P>", "<S>", "<M>")


def cuts(text: Column, first: Column, second: Column, unit: str = UNIT) -> Column:
    """struct<n, a, b>: the number of units, and the borders (in code points) after the
    smaller and the larger of ``first % (n + 1)`` and ``second % (n + 1)`` units."""

    @F.pandas_udf("struct<n:long,a:long,b:long>")
    def run(texts: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
        import regex
        units = regex.compile(f"({unit})*+")
        out = []
        for t, x, y in zip(texts, one, two):
            match = units.fullmatch(t)
            ends = match.ends(1) if match else [len(t)]
            n = len(ends)
            i, j = sorted((x % (n + 1), y % (n + 1)))
            out.append((n, ends[i - 1] if i else 0, ends[j - 1] if j else 0))
        return pd.DataFrame(out, columns=["n", "a", "b"], dtype="int64")

    return run(text, first, second)


def _digits(seed: int, doc_id: Column, group: int) -> Column:
    """The ``group``-th 8 hex digits of sha256('seed:doc_id') as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80,
                   markers: Sequence[str] = MARKERS, unit: str = UNIT) -> DataFrame:
    """``docs`` (with all its columns as ``_row``) plus n, form, prefix_chars,
    middle_chars and output.

    ``rate`` percent of the documents are rearranged, ``spm`` percent of them with the
    suffix first: ``<S>suffix<P>prefix<M>middle``, the others as
    ``<P>prefix<S>suffix<M>middle``. No marker may begin as it ends.
    """
    p, s, m = (F.lit(x) for x in markers)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    doc_id = F.col("_row.doc_id")
    rows = rows.withColumn("_text", F.coalesce(F.col("_row.text").cast("string"), F.lit("")))
    rows = rows.withColumn("_cut", cuts(F.col("_text"), _digits(seed, doc_id, 1), _digits(seed, doc_id, 2), unit))
    text, a, b = F.col("_text"), F.col("_cut.a").cast("int"), F.col("_cut.b").cast("int")
    plain = (text == "") | (_digits(seed, doc_id, 3) % 100 >= rate)
    for marker in (p, s, m):
        plain = plain | F.contains(text, marker)
    rows = rows.withColumn("form", F.when(plain, "plain").when(_digits(seed, doc_id, 4) % 100 < spm, "spm").otherwise("psm"))
    prefix, middle, suffix = F.substring(text, F.lit(1), a), F.substring(text, a + 1, b - a), F.substr(text, b + 1)
    cut = F.col("form") != "plain"
    return rows.select(
        "_row", F.col("_cut.n").alias("n"), "form", F.when(cut, F.col("_cut.a")).alias("prefix_chars"),
        F.when(cut, F.col("_cut.b") - F.col("_cut.a")).alias("middle_chars"),
        F.when(~cut, text).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .otherwise(F.concat(s, suffix, p, prefix, m, middle)).alias("output"))


def restore(rows: DataFrame, markers: Sequence[str] = MARKERS, name: str = "restored") -> DataFrame:
    """``rows`` plus the exact text rebuilt from the columns output and form. A text with
    no marker in it leaves each marker's first place unmistakable."""
    p, s, m = markers
    cut = F.col("form") != "plain"
    second = F.when(F.col("form") == "psm", F.lit(s)).otherwise(F.lit(p))
    lead = F.when(F.col("form") == "psm", F.lit(len(p))).otherwise(F.lit(len(s)))

    def after(text: Column, part: Column, marker: Column) -> Column:
        return F.substr(text, F.char_length(part) + F.char_length(marker) + 1)

    keep = rows.columns
    rows = rows.withColumn("_body", F.when(cut, F.substr("output", lead + 1))) \
        .withColumn("_one", F.when(F.col("form") == "psm", F.substring_index("_body", s, 1))
                    .otherwise(F.substring_index("_body", p, 1))) \
        .withColumn("_rest", after(F.col("_body"), F.col("_one"), second)) \
        .withColumn("_two", F.substring_index("_rest", m, 1)) \
        .withColumn("_middle", after(F.col("_rest"), F.col("_two"), F.lit(m)))
    return rows.select(*[F.col(f"`{c}`") for c in keep], F.when(~cut, F.col("output")).when(
        F.col("form") == "psm", F.concat("_one", "_middle", "_two")).otherwise(
        F.concat("_two", "_middle", "_one")).alias(name))
