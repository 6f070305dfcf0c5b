"""Exact similarity join of documents on their sets of word shingles.

Two sets with Jaccard similarity t or more share at least l of their first
n - ceil(t n) + l tokens in any common order of the tokens (l = 16 here, or the overlap
that t asks for where that is less). The order is rare tokens first, by the tokens'
counts over all documents, so that passages which many documents share stand last.
These extended prefixes are indexed:

* tokens met by one set only end at once;
* every set is compared with the leader of the token it shares most, and what links is
  one component from there on. Near copies thus cost one comparison each, not pairs;
* only tokens of two or more components are left, and only sets that hold enough of them
  (l, or as many as a link asks for), which is repeated until little more goes;
* of what is left, tokens that few sets hold (the rare class) are indexed alone. A token
  that many sets hold is replaced by its combinations with each later token of the set,
  and so is a combination that is still common, up to COMBINE tokens. Sets that share an
  entry at places which still allow the overlap that their sizes ask for may link: while there
  are more such pairs than rows, sets are compared with leaders of their entries and what links
  is one component, then all pairs left across components are compared.

Two sets of n and m tokens that link share o = ceil(t (n + m) / (1 + t)) tokens or more.
The k-th token they share, in the common order, has at least o - k shared ones after it, so
its place in either set is at most n - o + k - 1 (from 0). Their first k shared tokens are an
entry of both sets, whichever k its commonness asks for, so no link between components is
lost; and tokens of a template below the threshold stand behind each set's own rare ones,
at places too far for any entry. Comparison is on the texts themselves. Sets are named by a
64-bit key, exact copies share one.

Defined cases: a text that is null, empty or white space has an empty set and links with
nothing; with fewer than five words the whole sequence is its one shingle; repeated rows
are copies; a row with a null doc_id has a null component and links nothing; an empty
table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlens.llm.common import materialise, ragged, release, slices, utf8
from feedlens.llm.components import components
from feedlens.llm.shingles import set_keys, shingle_sets

LONGER = 16                   # l: so many tokens prefixes are longer by, and share if sets link
STAR_SHARES = 4               # tokens with its leader that make a comparison worth its while
FLUSH = 1_000_000             # tokens a task gathers before it sends them on
TEXT_BYTES = 1_000_000        # text hashed at once in a task (8-byte arrays of its length)
MAX_COMMON = 1_000_000        # most frequent tokens whose counts every task gets (12 MB)
COMMON_FROM = 4               # a token in fewer documents than this counts as rare
RARE_SETS = 48                # tokens and combinations of more sets are extended by one more token
COMBINE = 2                   # tokens of a combination at most: three make more entries than the pairs they save
PART_TOKENS = 1_500_000       # tokens of the whole corpus that one task counts or matches
LEADERS = 16                  # sets of a large entry that its others are compared with in a round
CLOSEST = 32                  # of those, over all its entries, that a set is compared with
MAX_BROADCAST_IDS = 500_000   # ids whose texts a join may fetch by broadcast (12 MB)
MEMBERS_PER_TASK = 2_000
_BLOBS = {names: pa.schema([("part", pa.int32()), *[(x, pa.binary()) for x in names]])
          for names in (("tokens", "many", "count"), ("tokens", "owner", "place", "keys", "n"))}


def _narrow(tokens: np.ndarray) -> np.ndarray:
    """48 bits of a token: enough to order and to find candidates, which are then compared."""
    return tokens >> np.uint64(16)


def _pack(sorted_tokens: np.ndarray) -> bytes:
    """Sorted 48-bit tokens as 4-byte steps, or as they are where a step is too wide."""
    steps = np.diff(sorted_tokens, prepend=np.uint64(0))
    head = sorted_tokens[:1]
    if len(steps) > 1 and steps[1:].max() < 1 << 32:
        return b"s" + head.tobytes() + steps[1:].astype(np.uint32).tobytes()
    return b"w" + sorted_tokens.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if data[:1] == b"w":
        return np.frombuffer(data, np.uint64, offset=1)
    head = np.frombuffer(data, np.uint64, 1, 1)
    return np.cumsum(np.concatenate([head, np.frombuffer(data, np.uint32, offset=9).astype(np.uint64)]))


def _by_part(tokens: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of sorted 48-bit tokens, parts being equal ranges of them."""
    bounds = (np.arange(1, parts, dtype=np.uint64) * np.uint64((1 << 48) // parts))
    cut = [0, *np.searchsorted(tokens, bounds).tolist(), len(tokens)]
    return [(p, a, b) for p, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]


def _sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat, off = shingle_sets(*utf8(batch.column("text")))
    return flat, off, set_keys(flat, off)


def _nodes(docs: DataFrame) -> DataFrame:
    """doc_id, key (null for an empty set), n of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=TEXT_BYTES):
            _, off, keys = _sets(batch)
            n = np.diff(off)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(keys.astype(np.int64), mask=n == 0), pa.array(n)],
                ["doc_id", "key", "n"])
    return docs.mapInArrow(run, "doc_id long, key long, n long")


def _common_tokens(docs: DataFrame, parts: int, held: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The frequent tokens (sorted, 48 bits) and their document counts, from all documents:
    as many as MAX_COMMON allows, the most frequent first."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            tokens, count = np.unique(np.concatenate(held), return_counts=True)
            rows = []
            for p, a, b in _by_part(tokens, parts):
                many = np.flatnonzero(count[a:b] > 1)
                rows.append({"part": p, "tokens": _pack(tokens[a:b]), "many": many.astype(np.uint32).tobytes(),
                             "count": count[a:b][many].astype(np.uint32).tobytes()})
            yield pa.RecordBatch.from_pylist(rows, _BLOBS["tokens", "many", "count"])
            held.clear()

        for batch in slices(batches, limit=TEXT_BYTES):
            held.append(_narrow(_sets(batch)[0]))
            if sum(map(len, held)) > FLUSH:
                yield from flush()
        if sum(map(len, held)):
            yield from flush()

    def count(f: pd.DataFrame) -> pd.DataFrame:
        tokens, weight = [], []
        for t, m, c in zip(f["tokens"], f["many"], f["count"]):
            own = _unpack(t)
            w = np.ones(len(own), np.uint32)
            w[np.frombuffer(m, np.uint32)] = np.frombuffer(c, np.uint32)
            tokens.append(own)
            weight.append(w)
        tokens, weight = np.concatenate(tokens), np.concatenate(weight)
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        total = np.add.reduceat(weight[order].astype(np.int64), first)
        keep = total >= COMMON_FROM
        return pd.DataFrame({"token": tokens[first][keep].astype(np.int64), "n": total[keep]})

    sent = docs.select("text").mapInArrow(send, "part int, tokens binary, many binary, count binary")
    found = materialise(sent.groupBy("part").applyInPandas(count, "token long, n long"), "common-tokens", held)
    step = F.floor(F.log2("n") * 8)                 # at most 8 * 63 steps reach the driver
    least, have = 1 << 62, 0                        # none, if even the most frequent are too many
    for r in found.groupBy(step.alias("s")).agg(F.count("*").alias("c"), F.min("n").alias("least")) \
            .orderBy(F.desc("s")).collect():
        have += r["c"]
        if have > MAX_COMMON:
            break
        least = r["least"]
    else:
        least = COMMON_FROM

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:                       # arrays, not a row per token, go to the driver
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy().tobytes()], pa.binary()) for c in batch.columns],
                                             ["tokens", "counts"])

    rows = found.where(F.col("n") >= least).select("token", "n").mapInArrow(pack, "tokens binary, counts binary").collect()
    tokens = np.frombuffer(b"".join(r["tokens"] for r in rows), np.uint64)
    counts = np.frombuffer(b"".join(r["counts"] for r in rows), np.int64)
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def _prefixes(flat: np.ndarray, off: np.ndarray, common: tuple[np.ndarray, np.ndarray],
              numerator: int, denominator: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in ``flat`` of every set's extended prefix, how many each set has)."""
    tokens, counts = common
    n = np.diff(off)
    at = np.searchsorted(tokens, flat)
    at[at == len(tokens)] = 0
    hit = tokens[at] == flat if len(tokens) else np.zeros(len(flat), bool)
    weight = np.where(hit, counts[at], 0) if len(tokens) else np.zeros(len(flat), np.int64)
    size = np.where(n > 1, np.minimum(n, n - -(-numerator * n // denominator) + LONGER), 0)
    out = []
    for d in np.flatnonzero(size).tolist():
        a, b = off[d], off[d + 1]
        w = weight[a:b]
        rare = np.flatnonzero(w == 0)[:size[d]]
        if len(rare) < size[d]:
            often = np.flatnonzero(w)
            rare = np.concatenate([rare, often[np.argsort(w[often], kind="stable")][:size[d] - len(rare)]])
        out.append(a + rare)
    return (np.concatenate(out) if out else np.zeros(0, np.int64)), size


def _shared_postings(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], parts: int,
                     numerator: int, denominator: int) -> DataFrame:
    """(token, key, n, place) of the prefix tokens that stand in two or more sets; ``place`` is
    the token's place in the set's order (65535 for that and all later ones)."""
    held_common = docs.sparkSession.sparkContext.broadcast(common)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            keys, at = np.unique(np.concatenate([h[1] for h in held]), return_index=True)
            n = np.concatenate([h[2] for h in held])[at]
            tokens = np.concatenate([h[0] for h in held])
            owner = np.searchsorted(keys, np.repeat(np.concatenate([h[1] for h in held]),
                                                    np.concatenate([h[3] for h in held])))
            sizes = np.concatenate([h[3] for h in held])
            place = np.minimum(ragged(np.zeros(len(sizes), np.int64), sizes), 65535).astype(np.uint16)
            order = np.lexsort((place, owner, tokens))
            tokens, owner, place = tokens[order], owner[order].astype(np.uint32), place[order]
            once = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])])
            tokens, owner, place = tokens[once], owner[once], place[once]
            rows = []
            for p, a, b in _by_part(tokens, parts):
                used, local = np.unique(owner[a:b], return_inverse=True)
                rows.append({"part": p, "tokens": _pack(tokens[a:b]), "owner": local.astype(np.uint32).tobytes(),
                             "place": place[a:b].tobytes(), "keys": keys[used].tobytes(), "n": n[used].astype(np.int64).tobytes()})
            yield pa.RecordBatch.from_pylist(rows, _BLOBS["tokens", "owner", "place", "keys", "n"])
            held.clear()

        for batch in slices(batches, limit=TEXT_BYTES):
            flat, off, keys = _sets(batch)
            flat = _narrow(flat)
            at, size = _prefixes(flat, off, held_common.value, numerator, denominator)
            held.append((flat[at], keys, np.diff(off), size))
            if sum(len(h[0]) for h in held) > FLUSH:
                yield from flush()
        if sum(len(h[0]) for h in held):
            yield from flush()

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        tokens = np.concatenate([_unpack(t) for t in f["tokens"]])
        keys, n = [], []
        for o, k, size in zip(f["owner"], f["keys"], f["n"]):
            at = np.frombuffer(o, np.uint32)
            keys.append(np.frombuffer(k, np.uint64)[at])
            n.append(np.frombuffer(size, np.int64)[at].astype(np.int32))
        keys, n = np.concatenate(keys), np.concatenate(n)
        place = np.concatenate([np.frombuffer(p, np.uint16) for p in f["place"]])
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        edge = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1], [True]]))
        runs = np.flatnonzero(np.diff(edge) > 1)
        at = ragged(edge[runs], np.diff(edge)[runs])
        return pd.DataFrame({"token": tokens[at].astype(np.int64), "key": keys[order[at]].astype(np.int64),
                             "n": n[order[at]], "place": place[order[at]].astype(np.int32)}) \
            .drop_duplicates(["token", "key"])

    sent = docs.select("text").mapInArrow(
        send, "part int, tokens binary, owner binary, place binary, keys binary, n binary")
    return sent.groupBy("part").applyInPandas(meet, "token long, key long, n int, place int")


def _able(posts: DataFrame, numerator: int, denominator: int, held: list[str]) -> DataFrame:
    """Postings (with ``comp``) of the tokens of two or more components, in the sets that hold
    as many of them as any link asks for. Each round is exact; the last one saves little."""
    need = F.least(F.lit(LONGER), F.ceil(F.col("n") * numerator / denominator))
    before = None
    while True:
        crossing = posts.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
        posts = posts.join(crossing.select("token"), "token")
        able = posts.groupBy("key").agg(F.count("*").alias("c"), F.first("n").alias("n")).where(F.col("c") >= need)
        posts = materialise(posts.join(able.select("key"), "key", "left_semi"), "crossing", held)
        now = posts.count()
        if not now or before is not None and now > 0.9 * before:
            return posts
        before = now


def _index(posts: DataFrame, numerator: int, denominator: int, held: list[str]) -> DataFrame:
    """(entry, k, key, n, first, last): the entries of two or more components, k tokens each."""
    posts = _able(posts, numerator, denominator, held)
    least = F.ceil(F.col("n") * numerator / denominator).cast("int")     # overlap of any link
    # A set's later tokens, in the common order: what an entry may be extended by.
    own = posts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("own"))
    entries = posts.where(F.col("place") <= F.col("n") - least).select(
        F.col("token").alias("entry"), "key", "n", "comp", F.col("place").alias("first"), F.col("place").alias("last"))
    index: list[DataFrame] = []
    for k in range(1, COMBINE + 1):
        entries = materialise(entries, "entries", held)
        buckets = entries.groupBy("entry").agg(F.count("*").alias("sets"), F.min("comp").alias("c0"), F.max("comp").alias("c1"),
                                               F.min(least).alias("least")).where("c0 <> c1")
        buckets = materialise(buckets.select("entry", ((F.col("sets") > RARE_SETS) & (F.col("least") > k)
                                                       & F.lit(k < COMBINE)).alias("more")), "buckets", held)
        index.append(entries.join(buckets.where("not more"), "entry").select(
            "entry", F.lit(k).alias("k"), "key", "n", "first", "last"))
        if k == COMBINE or buckets.where("more").isEmpty():
            break
        longer = entries.join(buckets.where("more"), "entry").join(own, "key")
        later = F.filter("own", lambda x: (x["place"] > F.col("last")) & (x["place"] <= F.col("n") - least + k))
        entries = longer.select("entry", "key", "n", "comp", "first", F.explode(later).alias("x")).select(
            F.xxhash64("entry", "x.token").alias("entry"), "key", "n", "comp", "first", F.col("x.place").alias("last"))
    return materialise(reduce(DataFrame.union, index), "index", held)


def _meeting(index: DataFrame, other: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Rows of ``index`` with those of ``other`` (the same columns) of their entry: of another
    component, at places that allow the overlap which the sizes ask for."""
    other = other.select(F.col("entry").alias("e"), F.col("k").alias("j"), F.col("key").alias("lead"), F.col("n").alias("m"),
                         F.col("comp").alias("lead_comp"), F.col("first").alias("f"), F.col("last").alias("l"))
    overlap = F.ceil((F.col("n") + F.col("m")) * numerator / (numerator + denominator))
    near = (F.col("first") <= F.col("n") - overlap) & (F.col("last") < F.col("n") - overlap + F.col("k")) \
        & (F.col("f") <= F.col("m") - overlap) & (F.col("l") < F.col("m") - overlap + F.col("k"))
    return index.join(other, (F.col("entry") == F.col("e")) & (F.col("k") == F.col("j"))
                      & (F.col("comp") != F.col("lead_comp")) & near)


def _candidates(index: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Distinct (lead, key) that share an entry of ``index``, across components."""
    return _meeting(index, index, numerator, denominator).where("lead < key").select("lead", "key").distinct()


def _with_components(rows: DataFrame, edges: list[DataFrame], held: list[str]) -> DataFrame:
    """``rows`` with ``comp``, the component of their key by the ``edges`` found so far."""
    if not edges:
        return rows.withColumn("comp", F.col("key"))
    known = components(reduce(DataFrame.union, edges), held=held).withColumnRenamed("node", "key")
    return rows.join(known, "key", "left").withColumn("comp", F.coalesce("component", "key")).drop("component")


def _last_links(posts: DataFrame, edges: list[DataFrame], docs: DataFrame, reps: DataFrame, numerator: int,
                denominator: int, held: list[str]) -> list[DataFrame]:
    """``edges`` with links enough that no two components are left between which a set links.

    While an entry holds more than LEADERS pairs across components for each of its sets, it has
    LEADERS leaders, others in each round, and every set is compared with the CLOSEST of them,
    by the entries it shares with each; what links is one component from there on. The pairs
    left are then all compared, however many: rounds only take pairs away that are joined already.
    """
    index = _index(posts, numerator, denominator, held)
    crowd, edges, before, turn = index, list(edges), None, 0
    while True:
        crowd = _with_components(crowd.drop("comp"), edges, held)
        by_comp = crowd.groupBy("entry", "k", "comp").agg(F.count("*").cast("double").alias("c"))
        large = materialise(by_comp.groupBy("entry", "k").agg(
            F.sum("c").alias("sets"), ((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs"))
            .where(F.col("pairs") > LEADERS * F.col("sets")), "large", held)
        pairs = large.agg(F.sum("pairs").alias("pairs")).first()["pairs"]
        if pairs is None or before is not None and pairs > 0.9 * before:
            break
        before, turn = pairs, turn + 1
        crowd = materialise(crowd.join(large.select("entry", "k"), ["entry", "k"], "left_semi"), "crowd", held)
        at = F.xxhash64("entry", "key", F.lit(turn))
        leaders = crowd.groupBy("entry", "k", F.pmod(at, F.lit(LEADERS)).alias("slot")).agg(
            F.min(F.struct(at.alias("at"), "key", "n", "comp", "first", "last")).alias("x")) \
            .select("entry", "k", "x.key", "x.n", "x.comp", "x.first", "x.last")
        shared = _meeting(crowd, leaders, numerator, denominator).groupBy("key", "lead").agg(F.count("*").alias("c"))
        closest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("c"), "lead"))
        near = shared.withColumn("rank", closest).where(F.col("rank") <= CLOSEST).select("lead", "key")
        edges.append(_linked(near, docs, reps, numerator, denominator, held))
    index = _with_components(index, edges, held)
    return [*edges, _linked(_candidates(index, numerator, denominator), docs, reps, numerator, denominator, held)]


def _linked(pairs: DataFrame, docs: DataFrame, reps: DataFrame, numerator: int, denominator: int, held: list[str]) -> DataFrame:
    """Those of the distinct ``pairs`` (lead, key) whose texts link.

    Rows of a lead go to tasks of MEMBERS_PER_TASK members, each with the lead's own text
    first, and are compared as they stream by.
    """
    pairs = materialise(pairs, "pairs", held)
    leaders = pairs.groupBy("lead").agg(F.ceil(F.count("*") / MEMBERS_PER_TASK).cast("int").alias("salts"))
    members = pairs.join(leaders, "lead").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int")) \
        .select("lead", "salt", "key", F.lit(1).alias("order"))
    leads = leaders.select("lead", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                        F.col("lead").alias("key"), F.lit(0).alias("order"))
    wanted = materialise(members.union(leads).join(reps.select("key", F.col("rep").alias("_rep")), "key"), "wanted", held)
    if wanted.count() <= MAX_BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    rows = docs.join(wanted, F.col("doc_id") == F.col("_rep")).select("lead", "salt", "order", "key", "text")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.repartition(parts, "lead", "salt").sortWithinPartitions("lead", "salt", "order")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, lead_set = None, None
        for batch in slices(batches, limit=TEXT_BYTES):
            flat, off, keys = _sets(batch)
            out = []
            for d, (lead, salt, order, key) in enumerate(zip(*(batch.column(c).to_pylist() for c in (
                    "lead", "salt", "order", "key")))):
                if int(keys[d].astype(np.int64)) != key:     # another text under the same doc_id
                    continue
                own = flat[off[d]:off[d + 1]]
                if order == 0:
                    group, lead_set = (lead, salt), own.copy()
                elif group == (lead, salt):
                    both = len(np.intersect1d(lead_set, own, assume_unique=True))
                    if denominator * both >= numerator * (len(lead_set) + len(own) - both):
                        out.append((lead, key))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()),
                                              pa.array([o[1] for o in out], pa.int64())], ["a", "b"])

    return materialise(rows.mapInArrow(compare, "a long, b long"), "linked", held)


def similar_documents(docs: DataFrame, numerator: int = 4, denominator: int = 5, star_rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; similarity numerator / denominator."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held: list[str] = []
    nodes = materialise(_nodes(docs), "nodes", held)
    total = nodes.agg(F.sum("n")).first()[0] or 0
    parts = max(8, total // PART_TOKENS)
    reps = materialise(nodes.where("key is not null and doc_id is not null").groupBy("key")
                       .agg(F.min("doc_id").alias("rep")), "reps", held)
    common = _common_tokens(docs, parts, held)
    shared = materialise(_shared_postings(docs, common, parts, numerator, denominator), "postings", held)
    similar = (F.col("n") * denominator >= F.col("m") * numerator) & (F.col("m") * denominator >= F.col("n") * numerator)
    edges: list[DataFrame] = []
    for turn in range(star_rounds):
        posts = _with_components(shared, edges, held)
        # Another leader in each round: copies that miss one are near to the next.
        met = posts.groupBy("token").agg(
            F.min("comp").alias("c0"), F.max("comp").alias("c1"),
            F.min(F.struct(F.xxhash64("key", F.lit(turn)).alias("at"), "comp", "key", "n")).alias("first")) \
            .where("c0 <> c1")
        star = posts.join(met.select("token", F.col("first.key").alias("lead"), F.col("first.n").alias("m"),
                                     F.col("first.comp").alias("lead_comp")), "token") \
            .where((F.col("comp") != F.col("lead_comp")) & similar) \
            .groupBy("key", "lead").agg(F.count("*").alias("c"), F.min("n").alias("n")) \
            .where((F.col("c") >= STAR_SHARES) | (F.col("n") < 2 * LONGER)) \
            .groupBy("key").agg(F.max(F.struct("c", "lead")).alias("best"))
        pairs = star.select(F.col("best.lead").alias("lead"), "key")
        edges.append(_linked(pairs, docs, reps, numerator, denominator, held))
    edges = _last_links(_with_components(shared, edges, held), edges, docs, reps, numerator, denominator, held)
    groups = components(reduce(DataFrame.union, edges), held=held)
    least = reps.join(groups.withColumnRenamed("node", "key"), "key", "left") \
        .withColumn("component", F.coalesce("component", "key"))
    smallest = least.groupBy("component").agg(F.min("rep").alias("component_id"))
    least = least.join(smallest, "component").select(F.col("key").alias("k"), "component_id")
    found = materialise(nodes.join(least, F.col("key") == F.col("k"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")), "similar")
    release(docs.sparkSession, held)
    return found
