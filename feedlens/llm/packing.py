"""Best-fit packing of token sequences, planned on the histogram of lengths.

A plan needs only how many pieces there are of each length, so at most ``capacity``
rows reach the driver whatever the corpus. The plan is best-fit decreasing over counts:
lengths from long to short, each into the fullest bins that still have room, whole runs
of equal bins at a time. Its rows say "pieces of this length, ranks a to b, go to these
bins at this offset"; the pieces then take their slots by a join on rank within length.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each;
an empty table gives an empty result; only the columns named are read, so further
columns with any names do no harm.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlens.llm.chunks import worker_encoder
from feedlens.llm.common import materialise, slices, utf8

PLAN_SCHEMA = "p_length int, first long, n long, p_sequence long, per_bin long, p_offset long"
# A row takes about 48 bytes; larger plans are joined by a shuffle.
MAX_BROADCAST_PLAN = 200_000
# Text encoded at once: a worker holds several arrays of its length, beside the runs it remembers.
TEXT_BYTES = 2_000_000
RUNS = 400_000                # runs it remembers, about 150 bytes each
SPECIAL = ("<|startoftext|>", "<|endoftext|>")


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple]:
    """Rows (length, first rank, pieces, first sequence, pieces per sequence, offset).

    Piece ``first + i`` goes to sequence ``first sequence + i // per_bin`` at
    ``offset + (i % per_bin) * length``. Bins are kept as runs of neighbouring sequences
    with equal room left; a length takes whole runs and splits at most two, so the plan
    has a bounded number of rows whatever the counts are.
    """
    rows: list[tuple] = []
    free: list[tuple[int, int, int]] = []            # (room left, first bin, bins), sorted
    bins = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        at = bisect.bisect_left(free, (length, -1, -1))
        made, used = [], at
        while left:
            if used < len(free):
                room, start, n = free[used]
                used += 1
            else:
                per = capacity // length
                room, start, n = capacity, bins, -(-left // per)
                bins += n
            per = room // length
            full = min(n, left // per)
            if full:
                rows.append((length, rank, full * per, start, per, capacity - room))
                made.append((room - per * length, start, full))
                left, rank = left - full * per, rank + full * per
                start, n = start + full, n - full
            if n and left:                           # fewer than ``per`` are left: one more bin
                rows.append((length, rank, left, start, left, capacity - room))
                made.append((room - left * length, start, 1))
                start, n, left = start + 1, n - 1, 0
            if n:
                made.append((room, start, n))
        free[at:used] = []
        for group in made:
            if group[0]:
                bisect.insort(free, group)
    return rows


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1,
                 with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ``ids``)."""
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long"
    if with_ids:
        schema += ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()    # of what the stages before left in this worker
        texts = worker_encoder(vocabulary, SPECIAL, RUNS)
        for batch in slices(batches, limit=TEXT_BYTES):
            ids, off = texts(*utf8(batch.column("text")))
            doc, piece, start, size, crc, full = [], [], [], [], [], []
            for d, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                own = np.append(ids[off[d]:off[d + 1]], np.uint32(end_id)).astype("<u4")
                for k in range(0, len(own), capacity):
                    part = own[k:k + capacity]
                    doc.append(doc_id)
                    piece.append(k // capacity)
                    start.append(k)
                    size.append(len(part))
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        full.append(part.astype(np.int32))
            out = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                   pa.array(size, pa.int32()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out.append(pa.array(full, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = 4096, rows_per_salt: int = 200_000) -> DataFrame:
    """``pieces`` (with an int column ``length`` from 1 to ``capacity``) plus sequence_id and offset.

    ``pieces`` is read three times, so it should be a written table. Ranks are made per
    (length, salt), with as many salts as keep the commonest length at about
    ``rows_per_salt`` rows a window; the salts' counts turn them into ranks within length.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in
              pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan_rows = best_fit_plan(counts, capacity)
    salts = max(1, -(-max(counts.values(), default=1) // rows_per_salt))
    plan = spark.createDataFrame(plan_rows, PLAN_SCHEMA)
    if len(plan_rows) <= MAX_BROADCAST_PLAN:
        plan = F.broadcast(plan)
    key = [F.col(c) for c in ("doc_id", "piece", "ids_crc32")]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*key), F.lit(salts)).cast("int"))
    by_salt = salted.groupBy(F.col("length").alias("s_length"), F.col("_salt").alias("s_salt")) \
        .agg(F.count("*").alias("s_n"))
    before = Window.partitionBy("s_length").orderBy("s_salt").rowsBetween(Window.unboundedPreceding, -1)
    by_salt = by_salt.withColumn("s_before", F.coalesce(F.sum("s_n").over(before), F.lit(0))).drop("s_n")
    inner = Window.partitionBy("length", "_salt").orderBy(*key)
    ranked = salted.withColumn("_rank", F.row_number().over(inner) - 1) \
        .join(by_salt, (F.col("length") == F.col("s_length")) & (F.col("_salt") == F.col("s_salt"))) \
        .withColumn("_rank", F.col("_rank") + F.col("s_before"))
    i = F.col("_rank") - F.col("first")
    return ranked.join(plan, (F.col("length") == F.col("p_length")) & (F.col("_rank") >= F.col("first"))
                       & (F.col("_rank") < F.col("first") + F.col("n"))) \
        .withColumn("sequence_id", F.col("p_sequence") + F.floor(i / F.col("per_bin")).cast("long")) \
        .withColumn("offset", F.col("p_offset") + (i % F.col("per_bin")) * F.col("length")) \
        .drop("_salt", "_rank", "s_length", "s_salt", "s_before", *[c.split()[0] for c in PLAN_SCHEMA.split(", ")])


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    pieces = materialise(token_pieces(docs, vocabulary, capacity, end_id), "pieces")
    return pack(pieces, capacity).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        "sequence_id", "offset")
