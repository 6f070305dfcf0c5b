"""Token-id files: documents in ascending doc_id order as range-coded segments.

The table of files has one row per segment: ``file`` (a range of doc_ids), ``segment``
within it and the segment's bytes (``payload``, see ``idcoder``). A segment holds whole
documents, about ``SEGMENT`` ids of them, and can be read alone.

Defined cases: a null or empty text is the end id alone; a null doc_id comes first; rows
that repeat a doc_id are ordered by their text; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlens.llm.chunks import worker_encoder
from feedlens.llm.common import materialise, slices, utf8
from feedlens.llm.idcoder import read_segments, write_segments

SEGMENT = 1 << 20
TOGETHER = 6 << 20            # ids coded side by side: more lanes, fewer steps
SPECIAL = ("<|endoftext|>",)


def write_ids(docs: DataFrame, vocabulary: str, end_id: int, files: int) -> DataFrame:
    """The table of files, written to the shared scratch folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = worker_encoder(vocabulary, SPECIAL)
        file, made = TaskContext.get().partitionId(), 0
        done: list[tuple] = []
        doc_ids: list[int | None] = []
        sizes: list[int] = []
        ids: list[np.ndarray] = []

        def close() -> None:
            done.append((list(doc_ids), np.array(sizes), np.concatenate(ids).astype(np.uint32)))
            doc_ids.clear()
            sizes.clear()
            ids.clear()

        def write() -> pa.RecordBatch:
            nonlocal made
            rows = [{"file": file, "segment": made + k, "payload": p} for k, p in enumerate(write_segments(done))]
            made += len(rows)
            done.clear()
            return pa.RecordBatch.from_pylist(rows, pa.schema(
                [("file", pa.int32()), ("segment", pa.int32()), ("payload", pa.binary())]))

        held = 0
        for batch in slices(batches):
            flat, off = texts(*utf8(batch.column("text")))
            for d, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                ids.append(np.append(flat[off[d]:off[d + 1]], np.uint32(end_id)))
                doc_ids.append(doc_id)
                sizes.append(len(ids[-1]))
                held += sizes[-1]
                if held >= SEGMENT:
                    close()
                    held = 0
                if sum(len(x[2]) for x in done) >= TOGETHER:
                    yield write()
        if doc_ids:
            close()
        if done:
            yield write()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(files, F.asc_nulls_first("doc_id")) \
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    return materialise(rows.mapInArrow(run, "file int, segment int, payload binary"), "id-files")


def read_ids(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """file, segment, place, doc_id, n_tokens, ids_crc32 (and ``ids``) of every document."""
    schema = "file int, segment int, place int, doc_id long, n_tokens long, ids_crc32 long"
    if with_ids:
        schema += ", ids array<int>"

    def rows(held: list[dict]) -> Iterator[pa.RecordBatch]:
        for at, (docs, sizes, ids) in zip(held, read_segments([h["payload"] for h in held])):
            ends = np.cumsum(sizes)
            parts = [ids[e - s:e].astype("<u4") for e, s in zip(ends, sizes)]
            out = [pa.array([at["file"]] * len(docs), pa.int32()), pa.array([at["segment"]] * len(docs), pa.int32()),
                   pa.array(range(len(docs)), pa.int32()), pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()),
                   pa.array([zlib.crc32(p) for p in parts], pa.int64())]
            names = ["file", "segment", "place", "doc_id", "n_tokens", "ids_crc32"]
            if with_ids:
                out.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                if len(held) * SEGMENT >= TOGETHER:
                    yield from rows(held)
                    held.clear()
        if held:
            yield from rows(held)

    return files.mapInArrow(run, schema)


def encode_and_read(docs: DataFrame, vocabulary: str, end_id: int = 2, files: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the written files."""
    spark = docs.sparkSession
    files = files or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = materialise(read_ids(write_ids(docs, vocabulary, end_id, files)), "ids-read")
    totals = found.groupBy("file").agg(F.sum("n_tokens").alias("n")).orderBy("file").collect()  # a row per file
    before, starts = 0, []
    for r in totals:
        starts.append((r["file"], before))
        before += r["n"]
    place = F.broadcast(spark.createDataFrame(starts, "f int, before long"))
    segments = found.groupBy("file", "segment").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    segments = segments.join(place, F.col("file") == F.col("f")) \
        .select("file", "segment", (F.col("before") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("base"))
    inside = Window.partitionBy("file", "segment").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))) \
        .join(segments, ["file", "segment"]) \
        .select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
