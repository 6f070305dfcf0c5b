"""Mixing sources to target token counts by entropy balancing, native.

Each source has a target. Of all document rates that meet the targets, entropy balancing
takes those closest (in relative entropy) to one copy each, none above ``most``: rate =
min(most, exp(l * size)), with one multiplier l per source, which maximises the concave
dual. Newton steps find the multipliers: each is one aggregate over the counts of
(source, size), which gives every source the gradient (words now less target) and the
curvature; the step is taken in the logarithm of the words, where it is nearly straight,
and a bracket that always holds the root replaces any step that leaves it.

Rates become whole copies by running sums over the sizes of a source, largest first, so
that roundings cancel; what a source still misses is then made up by single sizes, the
largest that fits first. Within (source, size) the copies left over go to the documents
whose hashes come first.

Nothing is collected: the driver reads a few totals a round. A source's sizes stand in one
window; k unlike sizes take at least k * k / 2 words, so even 10**13 words have fewer than
5 million. Documents are ranked per (source, size, slot), with enough slots to keep the
commonest at ``rows_per_slot``; equal rows are one row with a count until the end.

Defined cases: a null or empty text, or one of white space, has size 0, rate and copies 1
and takes no words; a null source is a source, the last; a null doc_id is an id of its
own; rows that repeat doc_id, source and text are documents each; a source whose target
is ``most`` times its size takes every document so often; an empty table, or one without
words, gives targets 0; only doc_id, text and source are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.llm.common import materialise, release
from feedlens.operators.ordering import row_index

MAX_STEPS = 200               # a bracket alone halves its way to the last digit in fewer
_WORD = r"[^\x20\x09-\x0D]+"


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, hash, size and m, the number of equal rows."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.xxhash64(text).alias("hash"),
        F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long").alias("size")) \
        .groupBy("doc_id", "source", "hash", "size").agg(F.count("*").alias("m"))


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3) -> DataFrame:
    """``sizes`` (source, source_size) plus no, the source's place by code point (null
    last), and target: ``share`` of all words by the weights, which repeat in that order,
    no target above ``most`` times its source, the excess shared by weight again until
    none is above. Each round of sharing is one aggregate."""
    placed = row_index(sizes.withColumn("_none", F.col("source").isNull()), ("_none", "source"), "no").drop("_none")
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.col("no") % len(weights)).cast("int"))
    cap = most * F.col("source_size").cast("double")
    all_ = placed.agg(F.sum("source_size").alias("n"), F.sum(w).alias("w")).first()
    total = share * (all_["n"] or 0)
    level, capped = total / (all_["w"] or 1), None
    while True:
        at = F.lit(level) * w >= cap
        now = placed.agg(F.count_if(at).alias("k"), F.sum(F.when(at, cap).otherwise(0.0)).alias("gone"),
                         F.sum(F.when(at, 0.0).otherwise(w)).alias("w")).first()
        if now["k"] == capped or not now["w"]:
            break
        level, capped = (total - now["gone"]) / now["w"], now["k"]
    return placed.withColumn("target", F.least(cap, F.lit(level) * w))


def _rate(size: Column, l: Column, most: float) -> Column:
    """min(most, exp(l * size)); an infinite l stands for ``most`` at every size."""
    return F.when(size == 0, F.lit(1.0)).when(l == float("inf"), F.lit(float(most))) \
        .otherwise(F.least(F.lit(float(most)), F.exp(F.least(l * size, F.lit(700.0)))))


def _sum(terms: Column) -> Column:
    """A sum of doubles that does not depend on the order of the rows."""
    return F.sum(terms.cast("decimal(38,10)")).cast("double")


def multipliers(cells: DataFrame, sources: DataFrame, most: float, tolerance: float, held: list[str]) -> DataFrame:
    """no, l of every source with words, from ``cells`` (no, size, c) and ``sources``
    (no, source_size, target), by Newton steps on the dual."""
    x, words = F.col("size").cast("double"), F.col("c") * F.col("size").cast("double")
    spread = cells.where("size > 0").groupBy("no").agg(_sum(words * x).alias("xx"), F.min("size").cast("double").alias("least"))
    t, s, least = F.col("target"), F.col("source_size").cast("double"), F.col("least")
    full = t >= most * s * (1 - 1e-12)
    state = sources.join(spread, "no").select(
        "no", t, s.alias("s"), (full | (t == s)).alias("done"),
        F.when(t < s, F.log(t / s) / least).otherwise(0.0).alias("lo"),
        F.when(t < s, 0.0).otherwise(F.log(F.lit(float(most))) / least).alias("hi"),
        F.when(full, F.lit(float("inf"))).otherwise(F.log(t / s) * s / F.col("xx")).alias("l"))
    state = materialise(state.withColumn("l", F.when(F.col("done"), F.col("l")).otherwise(
        F.greatest("lo", F.least("hi", "l")))), "mix-state", held)
    for _ in range(MAX_STEPS):
        if state.where("not done").isEmpty():
            return state.select("no", "l")
        tilt = F.exp(F.least(F.col("l") * x, F.lit(700.0)))
        free = tilt < most
        sums = cells.where("size > 0").join(state.where("not done").select("no", "l"), "no").groupBy("no").agg(
            _sum(words * F.when(free, tilt).otherwise(float(most))).alias("f"),
            _sum(F.when(free, words * x * tilt).otherwise(0.0)).alias("g"))
        f, g, l = F.col("f"), F.col("g"), F.col("l")
        lo, hi = F.when(f < t, l).otherwise(F.col("lo")), F.when(f > t, l).otherwise(F.col("hi"))
        step = F.when((g > 0) & (f > 0), l + F.log(t / f) * f / g)
        middle = (lo + hi) / 2
        good = F.col("done") | (F.abs(f - t) <= tolerance * t) | (middle <= lo) | (middle >= hi)
        state = materialise(state.join(sums, "no", "left").select(
            "no", "target", "s", good.alias("done"), lo.alias("lo"), hi.alias("hi"),
            F.when(good, l).when((step > lo) & (step < hi), step).otherwise(middle).alias("l")), "mix-state", held)
    raise RuntimeError("the multipliers did not settle")


def _filled(cells: DataFrame, most: int, tolerance: float, held: list[str]) -> DataFrame:
    """``cells`` (no, size, c, k, target) with the copies k changed so that each source
    comes as near to its target as whole documents do by the largest size that fits."""
    while True:
        left = cells.groupBy("no").agg((F.first("target") - F.sum(F.col("k") * F.col("size"))).alias("r"))
        left = left.where(F.abs("r") > 0)
        room = F.when(F.col("r") > 0, most * F.col("c") - F.col("k")).otherwise(F.col("k"))
        fits = cells.where("size > 0").join(left, "no").where(
            (F.col("size") <= F.abs("r")) & (room > 0) & (F.abs("r") > tolerance * F.col("target")))
        pick = materialise(fits.groupBy("no").agg(F.max_by(F.struct(
            "size", (F.signum("r") * F.least(room, F.floor(F.abs("r") / F.col("size")))).cast("long").alias("d")),
            "size").alias("p")).select("no", "p.size", "p.d"), "mix-pick", held)
        if pick.isEmpty():
            return cells
        cells = materialise(cells.join(pick, ["no", "size"], "left")
                            .withColumn("k", F.col("k") + F.coalesce("d", F.lit(0))).drop("d"), "mix-cells", held)


def mix_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: int = 3,
                  tolerance: float = 1e-6, miss: float = 1e-3, rows_per_slot: int = 200_000) -> DataFrame:
    """doc_id, source, hash (of the text), size, source_size, target, rate and copies: one
    row per row of ``docs``. A source's words come within ``tolerance`` of its target
    before rates are rounded; after it they are moved on until within ``miss``, or as near
    as its documents allow."""
    held: list[str] = []
    rows = materialise(_documents(docs), "mix-documents")
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
    sources = materialise(targets(sizes, weights, share, most), "mix-sources", held)
    named = rows.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    cells = materialise(named.groupBy("no", "size").agg(
        F.sum("m").alias("c"), F.count("*").alias("rows"), F.first("target").alias("target"),
        F.first("source_size").alias("source_size")), "mix-cells", held)
    tilts = multipliers(cells, sources, most, tolerance, held)
    before = Window.partitionBy("no").orderBy(F.desc("size"))
    rated = cells.join(tilts, "no", "left").withColumn("rate", _rate(F.col("size"), F.col("l"), most)).drop("l")
    sum_ = F.sum(F.col("c") * F.col("rate")).over(before)
    rated = rated.withColumn("_to", F.floor(sum_ + 0.5)) \
        .withColumn("k", F.col("_to") - F.coalesce(F.lag("_to").over(before), F.lit(0))).drop("_to") \
        .withColumn("k", F.when(F.col("size") == 0, F.col("c")).otherwise(
            F.greatest(F.lit(0), F.least(F.col("k"), most * F.col("c")))))
    cells = _filled(materialise(rated, "mix-cells", held), most, miss, held)
    slots = max(1, -(-(cells.agg(F.max("rows")).first()[0] or 0) // rows_per_slot))
    slot = F.pmod(F.xxhash64("hash", "doc_id"), F.lit(slots))
    named = named.select("no", "doc_id", "source", "hash", "size", "m", slot.alias("slot"))
    earlier = Window.partitionBy("no", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = named.groupBy("no", "size", "slot").agg(F.sum("m").alias("m")) \
        .withColumn("start", F.coalesce(F.sum("m").over(earlier), F.lit(0))).drop("m") \
        .join(cells, ["no", "size"])
    place = Window.partitionBy("no", "size", "slot").orderBy(F.xxhash64("doc_id", "hash"), "doc_id", "hash") \
        .rowsBetween(Window.unboundedPreceding, -1)
    ranked = named.withColumn("_at", F.coalesce(F.sum("m").over(place), F.lit(0))).join(starts, ["no", "size", "slot"]) \
        .withColumn("_at", F.explode(F.sequence(F.col("_at") + F.col("start"), F.col("_at") + F.col("start") + F.col("m") - 1)))
    each, over = F.floor(F.col("k") / F.col("c")), F.col("k") % F.col("c")
    mixed = materialise(ranked.select(
        "doc_id", "source", "hash", "size", "source_size", "target", "rate",
        (each + (F.col("_at") < over).cast("long")).cast("long").alias("copies")), "mixed")
    release(docs.sparkSession, held)
    return mixed


def repeated(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """``docs``, each row as often as ``mixed`` says. Rows that repeat doc_id, source and
    text are taken from one of them."""
    key = [F.col("doc_id").cast("long").alias("_i"), F.col("source").cast("string").alias("_c"),
           F.xxhash64(F.col("text").cast("string")).alias("_h")]
    wanted = mixed.groupBy(F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), F.col("hash").alias("_hash")) \
        .agg(F.sum("copies").alias("_k"), F.count("*").alias("_m")).where("_k > 0")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *key)
    rows = rows.join(wanted, F.col("_i").eqNullSafe(F.col("_doc")) & F.col("_c").eqNullSafe(F.col("_source"))
                     & (F.col("_h") == F.col("_hash")))
    rows = rows.where("_m = 1").unionByName(rows.where("_m > 1").dropDuplicates(["_i", "_c", "_h"]))
    return rows.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_k")))) \
        .select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
