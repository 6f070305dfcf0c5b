"""One-permutation MinHash fingerprints, native.

A text's 5-word shingles are hashed once. The top bits of a hash name its bin, the least
hash of each bin is kept. An empty bin takes the value of a full bin: the one that comes
first in that bin's own fixed order of all bins (optimal densification, so that empty
bins choose independently). Of every bin the low ``BITS`` bits are packed; two unlike
bins agree in them with chance 2**-BITS, which the likeness takes off again.

Defined cases: a null or empty text, or one of white space, has the fingerprint '' and is
like another such text (1) and unlike any other (0); with fewer than five words the whole
sequence is one shingle; equal texts have equal fingerprints; repeated rows and equal
doc_ids are ordered by a hash of their text; a null doc_id comes last; an empty table
gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_BITS = 8
BINS = 1 << BIN_BITS
BITS = 8
WORDS = 5
# The order of bins for an empty bin: by a quadratic hash of (empty bin, full bin).
_P, _A, _B = (1 << 31) - 1, 1_103_515_245, 12_345_679
DIRECT = 8                    # so many bins of that order are tried before all are ranked
MAX_RANGES = 100_000


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _key(empty: int, full: int) -> int:
    y = empty * BINS + full + 1
    return (y * y % _P * _A + y * _B) % _P


def _tried(j: int) -> list[int]:
    """For each bin, the bin that stands j-th in its order."""
    return [sorted(range(BINS), key=lambda x, b=b: _key(b, x))[j] for b in range(BINS)]


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of a text's shingles (repeats included), in order; empty without words."""
    split = F.split(F.btrim(F.lower(text), F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+")
    hashed = F.transform(split, lambda w: F.xxhash64(w))
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), _let(hashed, lambda h: F.when(
        F.size(h) < words, F.array(F.xxhash64(h))).otherwise(F.transform(
            F.sequence(F.lit(1), F.size(h) - (words - 1)), lambda i: F.xxhash64(F.slice(h, i, F.lit(words))))))) \
        .otherwise(F.array().cast("array<bigint>"))


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS).cast("int")


def minima(hashes: Column) -> Column:
    """Map from bin to its least hash."""
    least = _let(F.sort_array(hashes), lambda s: F.filter(
        s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1)))))
    return _let(least, lambda m: F.map_from_arrays(F.transform(m, _bin), m))


def densified(least: Column) -> Column:
    """The BINS values, empty bins filled; an empty array if all are empty."""
    orders = [F.array(*[F.lit(x) for x in _tried(j)]) for j in range(DIRECT)]

    def ranked(m: Column, b: Column) -> Column:
        def place(x: Column) -> Column:
            y = (b * BINS + x + 1).cast("long")
            return ((y * y) % _P * _A + y * _B) % _P
        return F.array_min(F.transform(F.map_entries(m), lambda e: F.struct(
            place(e["key"]).alias("at"), e["value"].alias("value"))))["value"]

    def fill(m: Column, full: Column) -> Column:
        return F.transform(full, lambda v, b: F.coalesce(
            v, *[F.get(full, F.get(o, b)) for o in orders], ranked(m, b)))

    bins = F.array(*[F.lit(b) for b in range(BINS)])
    return F.when(F.size(least) > 0, _let(F.transform(bins, lambda b: F.try_element_at(least, b)),
                                          lambda full: fill(least, full))) \
        .otherwise(F.array().cast("array<bigint>"))


def packed(values: Column) -> Column:
    """The low BITS bits of each value, as lowercase hex."""
    return F.lower(F.array_join(F.transform(
        values, lambda v: F.substring(F.hex(v.bitwiseAND((1 << BITS) - 1) + (1 << BITS)), 2, BITS // 4)), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, 0 to 1."""
    size = BITS // 4
    places = F.array(*[F.lit(1 + size * i) for i in range(BINS)])
    same = F.size(F.filter(places, lambda i: F.substring(a, i, F.lit(size)) == F.substring(b, i, F.lit(size))))
    chance = 2.0 ** -BITS
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(
        F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance)))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``; each step is a column of its own, so nothing is computed twice."""
    return df.withColumn(f"{name}_m", minima(shingle_hashes(F.col(text)))) \
        .withColumn(name, packed(densified(F.col(f"{name}_m")))).drop(f"{name}_m")


def _place(heads: list[tuple], row: Column) -> Column:
    """The range of ``row``: the last one whose first row (``heads``, descending) is not
    below it, found by halving steps."""
    kind = "array<struct<known:int,doc_id:bigint,hash:bigint>>"
    firsts = F.from_json(F.lit(json.dumps([dict(zip(("known", "doc_id", "hash"), h)) for h in heads])), kind)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, len(heads).bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(firsts, at + step) >= row, at + step).otherwise(at))


def with_next(docs: DataFrame, per_range: int = 5_000) -> DataFrame:
    """Rows in ranges of (doc_id, hash of the text), of about equal numbers of rows, each
    with the row that follows in its range added as a marked row (``_extra``), so that a
    window over a range sees every row's next row.

    Spark's own range partitioning of the keys alone finds the ranges, so neither far
    outlying ids nor many null or equal ids crowd one; only rows equal in both id and text
    stay together. At most MAX_RANGES rows, one per range, pass the driver: the first row's
    id and the hash of its text.
    """
    spark = docs.sparkSession
    ranges = max(1, min(MAX_RANGES, docs.count() // per_range))
    rows = docs.withColumn("_hash", F.xxhash64("text"))
    key = F.struct(F.col("doc_id").isNotNull().cast("int").alias("known"),
                   F.coalesce(F.col("doc_id"), F.lit(0).cast("long")).alias("doc_id"), F.col("_hash").alias("hash"))
    found = rows.select(key.alias("key")).repartitionByRange(ranges, "key") \
        .groupBy(F.spark_partition_id()).agg(F.max("key").alias("key")).orderBy(F.desc("key")).collect()
    heads = [tuple(r["key"]) for r in found]
    rows = rows.withColumn("_range", _place(heads, key))
    into = [(d if known else None, h, (k - 1) % len(heads)) for k, (known, d, h) in enumerate(heads)]
    follow = F.broadcast(spark.createDataFrame(into, "h_id long, h_hash long, to_range int"))
    extra = rows.join(follow, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("_hash") == F.col("h_hash"))) \
        .dropDuplicates(["to_range"]) \
        .select("doc_id", "text", "_hash", F.col("to_range").alias("_range"), F.lit(1).alias("_extra"))
    return rows.select("doc_id", "text", "_hash", "_range", F.lit(0).alias("_extra")).unionByName(extra)


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    following = Window.partitionBy("_range").orderBy(
        "_extra", F.desc_nulls_last("doc_id"), F.desc("_hash"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs).withColumn("_next", F.coalesce(F.lead("text").over(following), F.lit(""))) \
        .withColumn("_edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("_next", F.lit(1), half)))
    rows = rows.select("doc_id", "_hash", "_range", "_extra", n.cast("long").alias("n_chars"), "text", "_edited",
                       F.sha2("_edited", 256).alias("edited_sha256"))
    rows = with_fingerprint(with_fingerprint(rows, "text", "fingerprint"), "_edited", "edited_fingerprint")
    rows = rows.drop("text", "_edited").withColumn("_next", F.lead("fingerprint").over(following))
    return rows.where("_extra = 0").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"))
