"""Removal of long byte strings that occur more than once in the corpus.

Bucket-pointer refinement over sampled suffixes. Every 400-byte window points to the
least 64-byte gram in it (the leftmost on a tie), which depends on the window's content
alone, so equal windows point to equal grams at equal offsets. The grams pointed to are
the initial buckets; those that hold one suffix end at once. What is left is refined by
the identifiers of longer strings around the pointer, each level from the identifiers of
the level before:

1. blocks of 64 neighbouring windows. The string that all windows of the block contain
   (its core) met once: none of them repeats. The string that spans the block met twice:
   all of them repeat;
2. blocks in between go down to single windows, whose own identifiers decide.

Identifiers are 64-bit hashes of exact spans; they are counted by partial aggregation and
joined back, so a passage that a third of all documents hold is one row per task. Texts
that occur more than once count as one source in the search; all their windows repeat.

Defined cases: a null or empty text keeps nothing and loses nothing; texts under the
window length lose only what the search finds, so nothing; repeated rows are copies of
each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import materialise, ragged, release, slices, utf8
from feedlens.llm.shingles import _power, mix

GRAM = 64
BLOCK = 64
SLICE = 600_000
# What may be sent to every task at once; more is joined by a shuffle of the texts.
MAX_BROADCAST_BYTES = 32 << 20
ROW_BYTES = 64
_BYTES = np.random.default_rng(20_240_611).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOW = np.uint64(0xFFFFFFFF)
_ODD = np.int64(0x5851F42D4C957F2D)


class Spans:
    """Identifiers of any byte spans of a buffer."""

    def __init__(self, buf: np.ndarray):
        up, self.back = _power(len(buf))
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTES[buf] * up[:len(buf)], out=self.sums[1:])

    def ids(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64)
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + length).astype(np.int64)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def pointers(buf: np.ndarray, docs: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(text, gram's offset, first window, windows, gram's id) of every gram that windows
    point to; offsets are within the buffer."""
    size = np.diff(docs)
    long = np.flatnonzero(size >= window)
    if not len(long):
        return (np.zeros(0, np.int64),) * 5
    spans = Spans(buf)
    start = np.arange(len(buf) - GRAM + 1)
    gram = spans.ids(start, start + GRAM).view(np.uint64)
    ranked = (gram & ~_LOW) | start.astype(np.uint64)
    least = _least(ranked, window - GRAM + 1)
    at = ragged(docs[long], size[long] - window + 1)
    points = (least[at] & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], points[1:] != points[:-1]]))
    count = np.diff(np.append(first, len(points)))
    text = np.searchsorted(docs, points[first], "right") - 1
    return text, points[first], at[first], count, gram[points[first]].view(np.int64)


def _batch(names: list[str], kinds: list, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, kinds)], names)


def _pointer_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=SLICE):
        buf, docs = utf8(batch.column("text"))
        text, at, lo, count, gram = pointers(buf, docs, window)
        row = batch.column("row").to_numpy()[text]
        yield _batch(["row", "a", "lo", "n", "gram"], [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()],
                     [row, at - docs[text], lo - docs[text], count, gram])


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """(which text each packed triple belongs to, the triples' columns)."""
    packed = batch.column("packed")
    size = np.array([len(p) // 12 for p in packed.to_pylist()], np.int64)
    flat = np.frombuffer(b"".join(packed.to_pylist()), np.int32).reshape(-1, 3).astype(np.int64)
    return np.repeat(np.arange(batch.num_rows), size), list(flat.T)


def _block_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=SLICE):
        buf, docs = utf8(batch.column("text"))
        which, (a, lo, n) = _unpacked(batch)
        most, least = a - lo, a - lo - n + 1         # offsets of the gram in the windows that point to it
        first = least // BLOCK
        blocks = most // BLOCK - first + 1
        at = np.repeat(np.arange(len(a)), blocks)
        block = ragged(first, blocks) * BLOCK
        which, a = which[at], a[at]
        low, high = np.maximum(block, least[at]), np.minimum(block + BLOCK - 1, most[at])
        base, spans = docs[which], Spans(buf)
        # The pointer's offset is part of an identifier: one span under two pointers is one place.
        core = spans.ids(base + a - block, base + a - block - (BLOCK - 1) + window) + block * _ODD
        s, e = a - block - (BLOCK - 1), a - block + window
        inside = (s >= 0) & (e <= docs[which + 1] - base)
        full = np.zeros(len(a), np.int64)
        full[inside] = spans.ids((base + s)[inside], (base + e)[inside]) + block[inside] * _ODD
        names = ["row", "a", "block", "low", "high", "core", "full"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(batch.column("row").to_numpy()[which]), *[pa.array(x.astype(np.int32)) for x in (a, block, low, high)],
             pa.array(core), pa.array(full, mask=~inside)], names)


def _window_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=SLICE):
        buf, docs = utf8(batch.column("text"))
        which, (a, low, high) = _unpacked(batch)
        n = high - low + 1
        at = np.repeat(np.arange(len(a)), n)
        p = a[at] - ragged(low, n)
        base = docs[which[at]]
        yield _batch(["row", "p", "id"], [pa.int64(), pa.int32(), pa.int64()],
                     [batch.column("row").to_numpy()[which[at]], p, Spans(buf).ids(base + p, base + p + window)])


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that spans cover."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.concatenate([[True], start[1:] > reach[:-1]]) if len(start) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return start[first], reach[np.append(first[1:] - 1, len(start) - 1)] if len(start) else reach


def _sent(small: DataFrame) -> DataFrame:
    """``small`` (row, perhaps packed) to be joined: by broadcast where its measured bytes
    allow, else by a shuffle."""
    size = F.count("*") * ROW_BYTES
    if "packed" in small.columns:
        size = size + F.coalesce(F.sum(F.length("packed")), F.lit(0))
    return F.broadcast(small) if (small.agg(size.alias("b")).first()["b"] or 0) <= MAX_BROADCAST_BYTES else small


def _pack_rows(batches: Iterator[pa.RecordBatch], merge: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("list")
        off = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        flat = lists.flatten()
        flat = np.stack([flat.field(k).to_numpy() for k in range(flat.type.num_fields)], 1).astype(np.int32)
        own = [flat[a:b] for a, b in zip(off, off[1:])]
        if merge:
            own = [np.stack(merge_spans(x[:, 0], x[:, 1]), 1) for x in own]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([x.tobytes() for x in own], pa.binary())],
                                         ["row", "packed"])


def _per_row(rows: DataFrame, fields: list[str], name: str, held: list[str], merge: bool = False) -> DataFrame:
    """(row, packed): a row's distinct tuples as 32-bit integers; as merged spans if asked."""
    lists = rows.groupBy("row").agg(F.collect_set(F.struct(*[F.col(f).cast("int").alias(f) for f in fields])).alias("list"))
    return materialise(lists.mapInArrow(partial(_pack_rows, merge=merge), "row long, packed binary"), name, held)


def repeated_spans(unique: DataFrame, window: int, held: list[str]) -> DataFrame:
    """(row, s, e): spans of ``unique`` (row, text; texts distinct) whose windows repeat."""
    text = unique.select("row", "text")
    points = materialise(text.mapInArrow(partial(_pointer_rows, window=window),
                                         "row long, a int, lo int, n int, gram long"), "pointers", held)
    often = points.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    wanted = _per_row(points.join(often, "gram"), ["a", "lo", "n"], "pointed", held)
    # The pointers grow with the texts: this join always shuffles, whatever their number.
    blocks = materialise(text.join(wanted.hint("shuffle_merge"), "row").mapInArrow(
        partial(_block_rows, window=window),
        "row long, a int, block int, low int, high int, core long, full long"), "blocks", held)
    cores = blocks.groupBy("core").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    fulls = blocks.where("full is not null").groupBy("full").agg(F.count("*").alias("c")).where("c > 1") \
        .select(F.col("full").alias("f"))
    known = materialise(blocks.join(cores, "core").join(fulls, F.col("full") == F.col("f"), "left")
                        .withColumn("done", F.col("f").isNotNull()).drop("f"), "known", held)
    undecided = known.where("not done").select("core").distinct()
    # Where a core has undecided blocks, the decided ones stand by with one block each.
    by = known.where("done").groupBy("core", "full").agg(F.min(F.struct("row", "a", "low", "high")).alias("b")) \
        .join(undecided, "core", "left_semi").select("b.*")
    down = known.where("not done").select("row", "a", "low", "high").union(by)
    wanted = _per_row(down, ["a", "low", "high"], "undecided", held)
    windows = materialise(text.join(_sent(wanted), "row").mapInArrow(
        partial(_window_rows, window=window), "row long, p int, id long").distinct(), "windows", held)
    twice = windows.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    return known.where("done").select("row", (F.col("a") - F.col("block") - (BLOCK - 1)).alias("s"),
                                      (F.col("a") - F.col("block") + window).alias("e")) \
        .union(windows.join(twice, "id").select("row", F.col("p").alias("s"), (F.col("p") + window).alias("e")))


def _kept(batches: Iterator[pa.RecordBatch], window: int, carry: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        buf, docs = utf8(batch.column("text"))
        raw = buf.tobytes()
        packed = batch.column("packed").to_pylist()
        removed, runs, sha, kept = [], [], [], []
        for d, (copied, spans) in enumerate(zip(batch.column("copied").to_pylist(), packed)):
            data = raw[docs[d]:docs[d + 1]]
            if copied and len(data) >= window:
                s, e = np.zeros(1, int), np.array([len(data)])
            else:
                s, e = np.frombuffer(spans or b"", np.int32).reshape(-1, 2).T
            edges = [0, *np.stack([s, e], 1).ravel().tolist(), len(data)]
            rest = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            removed.append(len(data) - len(rest))
            runs.append(len(s))
            sha.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode("utf-8", "ignore"))
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in carry], pa.array(np.diff(docs)), pa.array(removed, pa.int64()),
             pa.array(runs, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())],
            [*carry, "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])


def remove_repeats(docs: DataFrame, window: int = 400) -> DataFrame:
    """Every row's columns but text (as ``_row``), n_bytes, n_removed, n_spans, kept_sha256 and
    the ``text`` left, without the pieces of characters that a removal cut through."""
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("row"),
                                   F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row"),
                                   F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
                       .withColumn("md5", F.md5("text")), "rows")
    first = rows.groupBy("md5").agg(F.min("row").alias("first"), F.count("*").alias("c")).where("c > 1")
    copied = materialise(rows.select("row", "md5").join(first, "md5")
                         .select("row", (F.col("row") != F.col("first")).alias("extra")), "copied")
    unique = rows.select("row", "text").join(_sent(copied.where("extra").select("row")), "row", "left_anti")
    held: list[str] = []
    spans = _per_row(repeated_spans(unique, window, held), ["s", "e"], "spans", [], merge=True)
    release(docs.sparkSession, held)
    joined = rows.join(_sent(copied.select("row", F.lit(True).alias("copied"))), "row", "left") \
        .join(_sent(spans), "row", "left") \
        .select("_row", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "packed")
    kind = rows.schema["_row"].dataType.simpleString()
    return joined.mapInArrow(partial(_kept, window=window, carry=["_row"]),
                             f"_row {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")
