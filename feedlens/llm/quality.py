"""Document quality by a linear-chain conditional random field over lines.

Every line that is not blank gets features of its bytes and words, and those of the line
before and the line after. The field's weights are fitted on a bounded sample of labelled
documents, every line bearing its document's label; exact forward-backward gives each
line's chance of being good, and a document's score is their mean, weighted by the lines'
lengths. Whole texts are read, in training too.

Defined cases: a null, empty or blank text has no line and gets the share of good
documents in the sample; repeated rows get the same score; without labelled rows all
scores are 0.5; an empty table gives an empty result. Labels, language, source and doc_id
are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import slices, utf8
from feedlens.llm.shingles import word_hashes

TEXT_BYTES = 2_000_000        # text whose lines a task works on at once (8-byte arrays of its length)
# Classes of bytes whose shares describe a line.
_CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b".",
            b",", b"!?", b"|", b"*%$#&", b"@/\\_=<>{}[]~^+", b"'\"-:;()`", bytes(range(128, 256)))
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _k, _bytes in enumerate(_CLASSES):
    _CLASS[list(_bytes)] = _k
KINDS = len(_CLASSES) + 1
OWN = 9                       # features of a line besides the shares of KINDS classes


def lines_of(buf: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line that is not blank, its length in bytes, each text's offsets)."""
    n = len(buf)
    cut = np.zeros(n + 1, bool)
    cut[docs] = True
    breaks = np.flatnonzero(buf == 10)
    cut[breaks] = True
    cut[breaks + 1] = True
    start = np.flatnonzero(cut[:n])
    length = np.diff(np.append(start, n))
    if not n:
        return np.zeros((0, 3 * (KINDS + OWN) + 2)), length, np.zeros(len(docs), np.int64)
    line = np.repeat(np.arange(len(start)), length)
    code = _CLASS[buf]
    counts = np.bincount(line * KINDS + code, minlength=len(start) * KINDS).reshape(-1, KINDS)
    full = (counts[:, 3] < length) & (buf[start] != 10)
    space = code == 3
    space |= buf == 10
    begins = ~space
    begins[1:] &= space[:-1] | cut[1:n]
    at = np.flatnonzero(begins)
    words = np.bincount(line[at], minlength=len(start))
    capital = np.bincount(line[at], weights=code[at] == 1, minlength=len(start))
    ends = np.flatnonzero(~space & np.append(space[1:] | cut[1:n], True))
    closing = code[ends]
    marked = np.bincount(line[ends], weights=(closing >= 6) & (closing < len(_CLASSES) - 1), minlength=len(start))
    short = np.bincount(line[at], weights=ends - at < 3, minlength=len(start))
    word, _ = word_hashes(buf, np.flatnonzero(np.append(cut[:n], True)))
    of = line[at]                                          # words of a line stand together
    again = np.zeros(len(at), bool)
    again[1:] = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((word, of))
    met = np.zeros(len(at), bool)
    met[1:] = (word[order[1:]] == word[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
    again, met = (np.bincount(x, weights=w, minlength=len(start)) for x, w in ((of, again), (of[order], met)))
    content = np.zeros(len(start), np.uint64)
    np.add.at(content, of, word)
    counts, length, start, content = counts[full], length[full], start[full], content[full]
    words, capital, marked, short, again, met = (v[full] for v in (words, capital, marked, short, again, met))
    same = np.concatenate([[False], content[1:] == content[:-1]])[:len(start)]
    some = np.maximum(words, 1)
    own = np.column_stack([counts / length[:, None], np.log1p(length) / 8, np.log1p(words) / 6, length / some / 12,
                           capital / some, marked / some, short / some, again / some, met / some, same])
    off = np.searchsorted(start, docs)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    first, last = off[:-1][np.diff(off) > 0], off[1:][np.diff(off) > 0] - 1
    before[first], after[last] = 0, 0
    ends_ = np.zeros((len(own), 2))
    ends_[first, 0], ends_[last, 1] = 1, 1
    return np.column_stack([own, before, after, ends_]), length, off


@dataclass
class Field:
    """Weights of a two-state linear chain; state 1 is good."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    step: np.ndarray                                       # log potentials of (state, next state)
    share: float

    def local(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return np.clip(z, -30, 30)


def marginals(z: np.ndarray, off: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each line's chance of state 1, expected counts of the steps), by scaled
    forward-backward on all chains at once."""
    size = np.diff(off)
    order = np.argsort(-size, kind="stable")
    start, size = off[:-1][order], size[order]
    good = 1 / (1 + np.exp(-z))
    local = np.column_stack([1 - good, good])
    move = np.exp(step - step.max())
    ahead, back = local.copy(), np.ones_like(local)
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
    for t in range(1, longest):
        at = start[:active[t]] + t
        a = (ahead[at - 1] @ move) * local[at]
        ahead[at] = a / a.sum(1, keepdims=True)
    expected = np.zeros((2, 2))
    for t in range(longest - 1, 0, -1):
        at = start[:active[t]] + t
        b = local[at] * back[at]
        pair = ahead[at - 1][:, :, None] * move * b[:, None, :]
        expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        b = b @ move.T
        back[at - 1] = b / b.sum(1, keepdims=True)
    both = ahead * back
    return both[:, 1] / both.sum(1), expected


def fit(x: np.ndarray, off: np.ndarray, labels: np.ndarray, rounds: int = 200, rate: float = 0.05,
        decay: float = 1e-3) -> Field:
    """Maximum conditional likelihood by Adam, each chain weighing the same."""
    size = np.diff(off)
    share = float(labels.mean()) if len(labels) else 0.5
    mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
    scale = np.maximum(x.std(0), 1e-3) if len(x) else np.ones(x.shape[1])
    field = Field(mean, scale, np.zeros(x.shape[1]), 0.0, np.zeros((2, 2)), share)
    if not len(x) or share in (0.0, 1.0):
        field.bias = 30.0 * np.sign(share - 0.5)
        return field
    scaled = np.clip((x - mean) / scale, -8, 8)
    y = np.repeat(labels, size).astype(float)
    seen = np.zeros((2, 2))
    seen[0, 0], seen[1, 1] = (np.maximum(size - 1, 0)[labels == v].sum() for v in (0, 1))
    theta = np.zeros(x.shape[1] + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        z = np.clip(scaled @ theta[:-5] + theta[-5], -30, 30)
        good, expected = marginals(z, off, theta[-4:].reshape(2, 2))
        miss = y - good
        grad = np.concatenate([scaled.T @ miss, [miss.sum()], (seen - expected).ravel()]) / len(y) - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        theta = theta + rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-8)
    field.weights, field.bias, field.step = theta[:-5], float(theta[-5]), theta[-4:].reshape(2, 2)
    return field


def scores(field: Field, buf: np.ndarray, docs: np.ndarray) -> np.ndarray:
    x, length, off = lines_of(buf, docs)
    good, _ = marginals(field.local(x), off, field.step)
    sums = np.concatenate([[0], np.cumsum(good * length)])
    weight = np.concatenate([[0], np.cumsum(length)])
    weight = (weight[off[1:]] - weight[off[:-1]])
    total = sums[off[1:]] - sums[off[:-1]]
    return np.where(weight > 0, np.clip(total / np.maximum(weight, 1), 0, 1), field.share)


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 3_000) -> Field:
    """The field fitted on at most ``sample`` labelled documents outside the held-out fold,
    those whose doc_ids hash lowest; a doc_id labelled both ways is left out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))) \
        .groupBy(F.col("doc_id").cast("long").alias("_id")) \
        .agg(F.min("quality").cast("int").alias("_y"), F.max("quality").alias("_max")).where("_y = _max") \
        .orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")) \
        .join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("_id", "_y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=TEXT_BYTES):
            x, _, off = lines_of(*utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_y"),
                 pa.array([x[a:b].astype(np.float32).tobytes() for a, b in zip(off, off[1:])], pa.binary())],
                ["id", "y", "x"])

    got = rows.mapInArrow(run, "id long, y int, x binary").toPandas().drop_duplicates("id").sort_values("id")
    wide = 3 * (KINDS + OWN) + 2
    parts = [np.frombuffer(b, np.float32).reshape(-1, wide).astype(float) for b in got["x"]]
    keep = [k for k, p in enumerate(parts) if len(p)]
    x = np.concatenate([parts[k] for k in keep]) if keep else np.zeros((0, wide))
    off = np.concatenate([[0], np.cumsum([len(parts[k]) for k in keep])]).astype(np.int64)
    return fit(x, off, got["y"].to_numpy()[keep] if keep else np.zeros(0))


def classify(docs: DataFrame, field: Field, threshold: float = 0.7) -> DataFrame:
    """``docs`` (with all its columns as ``_row``) plus score and predicted."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.col("text").cast("string").alias("text"))
    kind = rows.schema["_row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=TEXT_BYTES):
            s = scores(field, *utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                ["_row", "score", "predicted"])

    return rows.mapInArrow(run, f"_row {kind}, score double, predicted int")
