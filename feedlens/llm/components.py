"""Connected components of an edge table, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import materialise, release

MAX_ROUNDS = 60
ROWS_PER_TASK = 200_000       # links a task writes, so that few links are few files


def components(edges: DataFrame, a: str = "a", b: str = "b", held: list[str] | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of some edge.

    A round hangs each node's larger neighbours on its smallest one, then the smaller
    ones too; the number of rounds grows with the logarithm of the longest chain. Every
    round is written to the shared scratch folder. Minima are partial aggregates, so a
    node with very many edges costs one row per task. Null ends and loops are left out.
    The table that the result reads goes to ``held``.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    own: list[str] = []
    links = materialise(edges.where(F.col(a) != F.col(b)).select(u, v).distinct(), "links", own)
    before = None
    for _ in range(MAX_ROUNDS):
        stats = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (stats["n"], stats["x"]) == before or not stats["n"]:
            break
        before = stats["n"], stats["x"]
        both = links.union(links.select("v", "u"))
        low = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")) \
            .select("k", F.least("k", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, F.col("u") == F.col("k")) \
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every row of ``large`` points down: u > v
        low = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        joined = large.join(low, F.col("u") == F.col("k"))
        small = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .union(low.select("k", "m"))
        earlier, own = own, []
        links = materialise(small.distinct().coalesce(max(1, stats["n"] // ROWS_PER_TASK)), "links", own)
        release(links.sparkSession, earlier)
    else:
        raise RuntimeError("components did not settle")
    if held is not None:
        held += own
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .union(links.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
