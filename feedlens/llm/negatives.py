"""Hard negatives by integer inner products, with bounds along trees of anchors.

Anchors that lie near each other are joined to blocks, and each block to a spanning tree
of least edges. A candidate's score at the root is computed. From a node to its child the
score changes by at most (length of the edge) * (norm of the candidate), so the bounds at
the child follow from the score, or from the bounds, at its parent. Only candidates whose
bounds overlap what the child still looks for are scored there; that score then bounds
the next. What an anchor looks for: first the rows of its label that may be among its best,
then, once its positives are known, rows of other labels whose score may lie in the window
of one of them and among its best so far.

The rows stay where they are: the blocks go to all tasks, in rounds of at most
``ROUND_BYTES`` each (measured, not assumed), and every round reads the table once and
shuffles only the best few of every task. All tables are written to the shared folder.

Defined cases: rows with a null label, a null or empty vector, or a null or non-finite
component (also once scaled) take no part; vectors of unlike length have no score; rows
that repeat a vec_id are rows, and anchors, of their own; a null vec_id is no anchor and
comes last among equal scores; equal scores and ids are taken in any fixed order; an
anchor without positives, or a positive without negatives, gives no row; scores are exact
where the norms' product is below 2**63, beyond it they are rounded as doubles and held
within a long; an empty table gives an empty result; only three columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlens.llm.common import materialise, release

BLOCK = 512                   # anchors of a tree, about
MAX_CENTRES = 128
ROUND_BYTES = 16_000_000
SLICE = 4_096                 # candidates scored at once
EXACT = 2.0 ** 53             # products of norms below it: every sum of doubles is exact
LONGEST = (1 << 63) - 1
ANCHOR = "dims int, centre int, part int, row long, id long, label long, v array<double>"
FOUND = "anchor long, k int, score long, nameless boolean, id long, row long"


def scaled(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """row, id, label, dims and v, the floors of ``scale`` times the components, of the
    rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"),
                          F.col("label").cast("long").alias("label"), v.alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf")))
    # floor() of a double would give a long, which large components do not fit
    return rows.where(F.col("label").isNotNull() & (F.size("v") > 0) & good).select(
        "row", "id", "label", F.size("v").alias("dims"),
        F.transform("v", lambda x: F.when(F.abs(x * scale) < EXACT, F.floor(x * scale).cast("double"))
                    .otherwise(x * scale)).alias("v"))


def _matrix(v: pd.Series) -> np.ndarray:
    return np.array(v.tolist(), np.float64)


def _norms(m: np.ndarray) -> np.ndarray:
    """Lengths of the rows, without overflow inside."""
    top = np.maximum(np.abs(m).max(1), 1.0)
    return np.minimum(top * np.linalg.norm(m / top[:, None], axis=1), 1e300)


def spanning_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge): nodes in the order they join, each one's parent as a place
    in that order (-1 for the root) and its distance to it. Prim's algorithm."""
    n = len(v)
    order, parent, edge = np.zeros(n, int), np.full(n, -1), np.zeros(n)
    near, via, out = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
    at = int(np.argmin(_norms(v - v.mean(0))))
    for k in range(n):
        order[k], parent[k], edge[k], out[at] = at, via[at], near[at] if k else 0.0, False
        d = _norms(v - v[at])
        closer = out & (d < near)
        near[closer], via[closer] = d[closer], k
        if k + 1 < n:
            at = int(np.flatnonzero(out)[np.argmin(near[out])])
    return order, parent, edge


def trees(anchors: DataFrame, held: list[str], block: int = BLOCK) -> DataFrame:
    """TREE: the anchors in blocks of about ``block``, each a spanning tree. Blocks gather
    what is nearest to the same one of a bounded sample of anchors; those with one centre
    are dealt evenly by row, so no block grows with the table."""
    n = anchors.count()
    place = F.xxhash64("row")
    picked = anchors.orderBy(place, "row").limit(max(1, min(MAX_CENTRES, n // block))).select("dims", "v").toPandas()
    centres = {d: _matrix(f["v"]) for d, f in picked.groupby("dims")}

    def centre(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            near = np.zeros(len(f), np.int32)
            for d, at in f.groupby("dims").indices.items():
                if d in centres:
                    m, c = _matrix(f["v"].iloc[at]), centres[d]
                    near[at] = np.stack([_norms(m - one) for one in c], 1).argmin(1)
            yield f.assign(centre=near)

    near = materialise(anchors.select("dims", "row", "id", "label", "v").mapInPandas(
        centre, "dims int, row long, id long, label long, v array<double>, centre int"), "anchors", held)
    parts = near.groupBy("dims", "centre").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dealt = near.join(parts, ["dims", "centre"]).withColumn("part", F.pmod(place, F.col("parts")).cast("int"))

    def tree(f: pd.DataFrame) -> pd.DataFrame:
        order, parent, edge = spanning_tree(_matrix(f["v"]))
        return f.iloc[order].drop(columns="parts").assign(place=np.arange(len(f), dtype=np.int32),
                                                          parent=parent.astype(np.int32), edge=edge)

    found = dealt.select("dims", "centre", "part", "row", "id", "label", "v", "parts") \
        .groupBy("dims", "centre", "part").applyInPandas(tree, f"{ANCHOR}, place int, parent int, edge double")
    return materialise(found, "trees", held)


@dataclass
class Best:
    """The first few of the scores seen, best first."""

    score: np.ndarray
    nameless: np.ndarray
    id: np.ndarray
    row: np.ndarray

    @classmethod
    def none(cls) -> Best:
        return cls(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def merged(self, other: Best, keep: int) -> Best:
        both = [np.concatenate(pair) for pair in zip(vars(self).values(), vars(other).values())]
        if len(both[0]) > 8 * keep:
            last = np.partition(both[0], -keep)[-keep]
            both = [x[both[0] >= last] for x in both]
        # ~score falls as score rises, and cannot overflow
        order = np.lexsort((both[3], both[2], both[1], ~both[0]))[:keep]
        return Best(*[x[order] for x in both])


class Tree:
    """One block's anchors, parents first, with the best few found so far of each window.

    A window is (least, most) of the scores looked for; of equal labels when ``alike``."""

    def __init__(self, f: pd.DataFrame, alike: bool, keep: int):
        self.v, self.row, self.label = _matrix(f["v"]), f["row"].to_numpy(), f["label"].to_numpy()
        self.parent, self.edge, self.norm = f["parent"].to_numpy(), f["edge"].to_numpy(), _norms(self.v)
        self.alike, self.keep = alike, keep
        self.windows = [[(-LONGEST, LONGEST)] if alike else [(-(-4 * p // 5), p) for p in wanted]
                        for wanted in f["wanted"]]
        self.best = [[Best.none() for _ in w] for w in self.windows]

    def scores(self, k: int, m: np.ndarray, whole: np.ndarray | None, norms: np.ndarray) -> np.ndarray:
        top = self.norm[k] * norms.max(initial=0.0)
        if top < EXACT:
            return (m @ self.v[k]).astype(np.int64)
        with np.errstate(over="ignore", invalid="ignore"):
            exact = whole @ self.v[k].astype(np.int64)      # sums wrap, so they are right if the end fits
            rough = np.nan_to_num(m @ self.v[k], nan=0.0)
        held = np.where(rough >= 2.0 ** 63, LONGEST, np.where(rough <= -2.0 ** 63, -LONGEST, 0))
        return np.where(self.norm[k] * norms < 2.0 ** 63, exact, np.where(held != 0, held, np.clip(
            rough, -2.0 ** 62, 2.0 ** 62).astype(np.int64)))

    def meet(self, m: np.ndarray, label: np.ndarray, nameless: np.ndarray, id_: np.ndarray, row: np.ndarray) -> None:
        """Look at a slice of candidates."""
        norms = _norms(m)
        whole = None
        if self.norm.max() * norms.max() >= EXACT:
            with np.errstate(invalid="ignore"):
                whole = m.astype(np.int64)
        low, high = np.zeros((2, len(self.row), len(m)))
        for k in range(len(self.row)):
            up = self.parent[k]
            if up < 0:
                need = np.ones(len(m), bool)               # the root is scored for all
            else:
                reach = self.edge[k] * norms
                reach += 1 + 1e-9 * (self.norm[k] + self.norm[up]) * norms
                low[k], high[k] = low[up] - reach, high[up] + reach
                need = self._overlap(k, low[k], high[k]) & self._eligible(k, label, row)
            at = np.flatnonzero(need)
            if not len(at):
                continue
            if 2 * len(at) > len(m):                       # scoring all is then the quicker way
                s = self.scores(k, m, whole, norms)
                low[k] = high[k] = s
                s = s[at]
            else:
                s = self.scores(k, m[at], None if whole is None else whole[at], norms[at])
                low[k, at] = high[k, at] = s
            if up < 0:
                at = np.flatnonzero(self._eligible(k, label, row))
                s = s[at]
            for j, (least, most) in enumerate(self.windows[k]):
                best = self.best[k][j]
                if len(best.score) == self.keep:
                    least = max(least, int(best.score[-1]))
                hit = (s >= least) & (s <= most)
                if hit.any():
                    on = at[hit]
                    self.best[k][j] = best.merged(Best(s[hit], nameless[on], id_[on], row[on]), self.keep)

    def _eligible(self, k: int, label: np.ndarray, row: np.ndarray) -> np.ndarray:
        return (label == self.label[k]) & (row != self.row[k]) if self.alike else label != self.label[k]

    def _overlap(self, k: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Candidates whose bounds reach into a window, above the last of its best."""
        out = np.zeros(len(low), bool)
        for (least, most), best in zip(self.windows[k], self.best[k]):
            if least <= most:
                if len(best.score) == self.keep:
                    least = max(least, int(best.score[-1]))
                out |= (high >= least) & (low <= most)
        return out

    def found(self) -> Iterator[tuple]:
        for k, bests in enumerate(self.best):
            for j, b in enumerate(bests):
                for s, gone, i, r in zip(b.score.tolist(), b.nameless.tolist(), b.id.tolist(), b.row.tolist()):
                    yield int(self.row[k]), j, s, gone, i, r


def _search(rows: DataFrame, nodes: pd.DataFrame, alike: bool, keep: int) -> DataFrame:
    """FOUND: the best few of each window within each task, for the trees in ``nodes``."""
    blocks = [f.sort_values("place") for _, f in nodes.groupby(["dims", "centre", "part"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: dict[int, list[Tree]] = {}
        for f in blocks:
            forest.setdefault(int(f["dims"].iloc[0]), []).append(Tree(f, alike, keep))
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims):
                if int(d) not in forest:
                    continue
                some = batch.filter(pa.array(dims == d))
                for s in range(0, some.num_rows, SLICE):
                    part = some.slice(s, SLICE)
                    m = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                    ids = part.column("id")
                    named = (part.column("label").to_numpy(), ids.is_null().to_numpy(zero_copy_only=False),
                             ids.fill_null(0).to_numpy(), part.column("row").to_numpy())
                    for tree in forest[int(d)]:
                        tree.meet(m, *named)
        found = [x for trees_ in forest.values() for t in trees_ for x in t.found()]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], kind) for c, kind in enumerate(
            (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()))],
            ["anchor", "k", "score", "nameless", "id", "row"])

    return rows.select("row", "id", "label", "dims", "v").mapInArrow(run, FOUND)


def _rounds(rows: DataFrame, nodes: DataFrame, alike: bool, keep: int, held: list[str]) -> DataFrame:
    """The first ``keep`` of each (anchor, k) over the whole table: one pass per round."""
    cost = nodes.groupBy("dims", "centre", "part").agg(F.sum(F.col("dims") * 8 + 200).alias("bytes"))
    whole = cost.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    rounds = max(1, -(-(whole["bytes"] or 0) // ROUND_BYTES))
    dealt = F.pmod(F.xxhash64("dims", "centre", "part"), F.lit(rounds))
    while cost.groupBy(dealt).agg(F.sum("bytes").alias("b")).where(F.col("b") > ROUND_BYTES).count() and rounds < 4 * whole["n"]:
        rounds *= 2                                        # at the end each block has its own
        dealt = F.pmod(F.xxhash64("dims", "centre", "part"), F.lit(rounds))
    paths: list[str] = []
    for k in range(rounds):
        materialise(_search(rows, nodes.where(dealt == k).toPandas(), alike, keep), "found", paths)
    held += paths
    found = rows.sparkSession.read.schema(FOUND).parquet(*paths)
    order = Window.partitionBy("anchor", "k").orderBy(F.desc("score"), "nameless", "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep) \
        .withColumn("id", F.when(~F.col("nameless"), F.col("id")))


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5,
                   scale: int = 256, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by ``every``. Each one's positives are
    its ``positives`` best rows of its label; each positive's negatives are the first
    ``negatives`` rows of other labels with 80 to 100 % of its score.
    """
    held: list[str] = []
    rows = materialise(scaled(vectors, scale), "scaled", held)
    nodes = trees(rows.where(F.col("id") % every == 0), held, block)
    nothing = F.array().cast("array<bigint>")
    best = materialise(_rounds(rows, nodes.withColumn("wanted", nothing), True, positives, held), "positives", held)
    scores = best.groupBy(F.col("anchor").alias("row")).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("wanted"))
    wanted = materialise(nodes.join(scores, "row", "left").withColumn("wanted", F.coalesce("wanted", nothing)), "wanted", held)
    found = _rounds(rows, wanted, False, negatives, held).select(
        "anchor", "k", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    known = best.join(nodes.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor") \
        .select("anchor", (F.col("rank") - 1).alias("k"), F.col("rank").alias("positive_rank"), "anchor_id",
                F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    mined = materialise(found.join(known, ["anchor", "k"]).select(
        "anchor_id", "positive_id", "positive_rank", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    release(vectors.sparkSession, held)
    return mined
