"""Batch classification job.

Plan of ``tag_reviews``:

1. ``batch_rows``: dense input position -> ``batch_id = idx div 15``
   (distributed, see ``row_index``).
2. ``batches``: one row per batch, its (at most 15) rows gathered in order;
   a group never exceeds the batch size, whatever the data looks like.
3. ``call_tagger``: ``mapInArrow`` over the batches' reviews; the tagger (a pickled
   callable, rows -> reply text) runs once per batch inside a ``try``, so a
   failing batch becomes a status row instead of failing the job (T4).
   ``parallelism`` bounds how many calls run at once.
4. The replies are checkpointed to the shared checkpoint folder: the costly,
   non-repeatable step never re-runs when a later stage or a lost executor
   recomputes, and retries are idempotent per ``batch_id``.
   With a failure budget the batches are called in waves of consecutive batches, each
   read for its failures before the next one starts (``call_in_waves``).
5. ``parse_replies``: fence stripping, strict JSON, one row per element -
   all JVM-side (``from_json`` + ``inline``). A reply that does not parse
   fails its whole batch, as in the reference.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from feedlens import codebook as cb
from feedlens import schemas
from feedlens.functions.text import preview, strip_fence
from feedlens.operators.common import bounded_broadcast
from feedlens.operators.ordering import row_index
from feedlens.session import checkpoint_root, path_exists, scratch_path

# Batches asked about between two looks at the failures.
WAVE = 1_000
# Reviews that a task makes Python objects of at once.
READ_ROWS = 500

Tagger = Callable[[list[dict]], str]


def batch_rows(reviews: DataFrame, order_col="seq",
               size: int = cb.BATCH_SIZE) -> DataFrame:
    """Consecutive groups of ``size`` rows in input order; the last may be short."""
    return row_index(reviews, order_col).withColumn(
        "batch_id", F.floor(F.col("idx") / F.lit(size)).cast("long"))


def batches(batched: DataFrame, id_col: str = "reviewId", text_col: str = "content") -> DataFrame:
    """One row per batch: (batch_id, n_rows, rows array<struct<idx,id,text>>)."""
    return batched.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.array_sort(F.collect_list(F.struct(
            F.col("idx"), F.col(id_col).alias("id"), F.col(text_col).alias("text")))).alias("rows"))


def render_prompt(batched: DataFrame, id_col: str = "reviewId", text_col: str = "content",
                  preview_chars: int | None = None) -> DataFrame:
    """The prompt block of each batch (T2): ``ID: <id>\\nREVIEW: <text>`` lines
    joined by a blank line, in input order. ``preview_chars`` cuts each text (600 in the
    fixed prompt format, ``codebook.PROMPT_PREVIEW_CHARS``); None keeps it whole."""
    line = F.concat(F.lit("ID: "), F.col(id_col), F.lit("\nREVIEW: "),
                    preview(F.coalesce(F.col(text_col), F.lit("nan")), preview_chars))
    g = batched.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.array_sort(F.collect_list(F.struct(F.col("idx"), line.alias("line")))).alias("_l"))
    return g.select("batch_id", "n_rows",
                    F.array_join(F.col("_l.line"), "\n\n").alias("prompt"))


def batch_hash(tagger: Tagger) -> F.Column:
    """Hash of what a call asks: the ids and texts of ``rows`` in order, and the tagger's
    name (that of its function or class; taggers that differ otherwise need runs of their own)."""
    named = tagger if hasattr(tagger, "__qualname__") else type(tagger)
    rows = F.transform("rows", lambda r: F.struct(r["id"].alias("id"), r["text"].alias("text")))
    return F.sha2(F.to_json(F.struct(F.lit(f"{named.__module__}:{named.__qualname__}").alias("tagger"),
                                     rows.alias("rows"))), 256)


def _ask_tagger(tagger: Tagger, rows: list[dict]) -> tuple[str | None, str | None]:
    """(reply, error) of one call."""
    try:
        reply = tagger(rows)
        if reply is not None and not isinstance(reply, str):
            reply = json.dumps(reply)  # a tagger may return parsed tags
        return reply, None
    except Exception as e:  # noqa: BLE001 - a failed call is data (T4)
        return None, f"{type(e).__name__}: {e}"


def _call_batches(batch_df: DataFrame, tagger: Tagger, schema, kept: tuple[str, ...] = ()) -> DataFrame:
    """The tagger's result for every row of ``batch_df`` (batch_id, n_rows, rows), one call each;
    ``kept`` names columns that go from a batch to its result.

    A batch crosses to Python one review a row, in order, so a task's Python holds some
    reviews and one batch, not thousands of batches.
    """
    names = [f.name for f in schema.fields]
    kinds = to_arrow_schema(schema)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_batch, payload = None, []

        def answer() -> dict:
            reply, error = _ask_tagger(tagger, payload)
            return {**{c: open_batch[c] for c in ("batch_id", "n_rows", *kept)}, "reply": reply, "error": error}

        for frame in frames:
            done = []
            for at in range(0, frame.num_rows, READ_ROWS):
                for row in frame.slice(at, READ_ROWS).to_pylist():
                    if not row["nth"]:                       # the first review of the next batch
                        if open_batch is not None:
                            done.append(answer())
                        open_batch, payload = row, []
                    if row["nth"] is not None:
                        payload.append({"id": row["id"], "text": row["text"]})
            if done:
                yield pa.RecordBatch.from_pylist(done, kinds)
        if open_batch is not None:
            yield pa.RecordBatch.from_pylist([answer()], kinds)

    flat = batch_df.select("batch_id", "n_rows", *kept, F.posexplode_outer("rows").alias("nth", "r")) \
        .select("batch_id", "n_rows", *kept, "nth", F.col("r.id").alias("id"), F.col("r.text").alias("text"))
    return flat.mapInArrow(run, schema).select(*names)


def call_tagger(batch_df: DataFrame, tagger: Tagger, parallelism: int | None = None,
                materialize: bool = True, replies_dir: str | None = None,
                run_id: str | None = None) -> DataFrame:
    """Run ``tagger`` once per batch (T3, T4): (batch_id, n_rows, reply, error).

    With ``replies_dir`` every reply is kept as Parquet under ``run_id=<run_id>``, whether
    it parses or not, and a restarted run of the same ``run_id`` calls the tagger only for
    batches that have no stored reply or whose stored call failed. A reply stands only for
    a batch of the same number, ids, texts and tagger (``batch_hash``). Without it,
    ``materialize`` checkpoints the replies to the shared folder.
    """
    src = batch_df.select("batch_id", "n_rows", "rows")

    def in_flight(df: DataFrame) -> DataFrame:
        return df if parallelism is None else df.repartition(parallelism, "batch_id")

    if replies_dir is None:
        out = _call_batches(in_flight(src), tagger, schemas.BATCH_RESULT)
        if materialize:
            out = parse_reply_column(out)
            checkpoint_root(out.sparkSession)
            out = out.checkpoint(eager=True)
        return out
    path = _replies_path(replies_dir, run_id)
    # Kept once, so the calls and the replies looked up afterwards see the same batches.
    checkpoint_root(src.sparkSession)
    src = src.withColumn("batch_hash", batch_hash(tagger)).checkpoint(eager=True)
    _ask(src, tagger, path, parallelism)
    return _answers(src, path)


def _replies_path(replies_dir: str, run_id: str | None) -> str:
    return f"{replies_dir.rstrip('/')}/run_id={run_id or 'default'}"


def _ask(src: DataFrame, tagger: Tagger, path: str, parallelism: int | None) -> None:
    """Call the tagger for the batches of ``src`` that have no good reply under ``path``."""
    stored = stored_replies(src.sparkSession, path)
    if stored is not None:
        src = src.join(stored.select("batch_id", "batch_hash"), ["batch_id", "batch_hash"], "left_anti")
    if parallelism is not None:
        src = src.repartition(parallelism, "batch_id")
    _call_batches(src, tagger, schemas.STORED_REPLY, ("batch_hash",)).write.mode("append").parquet(path)


def _answers(src: DataFrame, path: str) -> DataFrame:
    done = stored_replies(src.sparkSession, path, failed=True)
    return src.select("batch_id", "batch_hash").join(done, ["batch_id", "batch_hash"]).drop("batch_hash")


def call_in_waves(batch_df: DataFrame, tagger: Tagger, budget: int, wave: int = WAVE,
                  parallelism: int | None = None, replies_dir: str | None = None,
                  run_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(replies, uncalled): as ``call_tagger``, but no call is made after a wave of ``wave``
    consecutive batches by whose end ``budget`` batches have failed (T5).

    So at most ``wave - 1`` calls come after the failure that a serial run stops at. The
    batches are written once, in order, so that a wave reads its own; the driver holds the
    number of failures. ``uncalled`` has batch_id and n_rows of the batches left.
    """
    spark = batch_df.sparkSession
    kept, path = scratch_path(spark, "batches"), _replies_path(replies_dir or scratch_path(spark, "replies"), run_id)
    src = batch_df.select("batch_id", "n_rows", "rows").withColumn("batch_hash", batch_hash(tagger))
    last = Observation()
    src.repartitionByRange("batch_id").sortWithinPartitions("batch_id") \
        .observe(last, F.max("batch_id").alias("at")).write.parquet(kept)
    src = spark.read.schema(src.schema).parquet(kept)
    end, start, failed = last.get["at"], 0, 0
    while end is not None and start <= end and failed < budget:
        now = src.where(F.col("batch_id").between(start, start + wave - 1))
        _ask(now, tagger, path, parallelism)
        status, _ = parse_replies(_answers(now, path))
        failed += status.where(~F.col("ok")).count()
        start += wave
    called = F.col("batch_id") < start
    if end is None:
        replies = src.select("batch_id", "n_rows", F.lit(None).cast("string").alias("reply"),
                             F.lit(None).cast("string").alias("error"))
    else:
        replies = _answers(src.where(called), path)
    return replies, src.where(~called).select("batch_id", "n_rows")


def stored_replies(spark, path: str, failed: bool = False) -> DataFrame | None:
    """One row per batch and hash with a stored reply, the successful one if a call was repeated;
    None without stored replies. ``failed`` adds the batches whose calls all failed."""
    if not path_exists(spark, path):               # nothing stored yet
        return None
    kept = spark.read.schema(schemas.STORED_REPLY).parquet(path)
    best = F.min(F.struct(F.col("error").isNotNull().alias("bad"), "n_rows", "reply", "error"))
    one = kept.groupBy("batch_id", "batch_hash").agg(best.alias("b"))
    if not failed:
        one = one.where("not b.bad")
    return one.select("batch_id", "batch_hash", "b.n_rows", "b.reply", "b.error")


def parse_reply_column(replies: DataFrame) -> DataFrame:
    """Add ``_parsed`` (array of R2 structs, null when the reply is not one JSON array).

    Strict: text before or after the array, single quotes and a bare object do not parse.
    """
    if "_parsed" in replies.columns:
        return replies
    text = strip_fence(F.col("reply"))
    whole = F.try_parse_json(text)
    is_array = F.schema_of_variant(whole).startswith("ARRAY")
    return replies.withColumn("_parsed", F.when(
        is_array & text.rlike(r"(?s)^\s*\[.*\]\s*$"),
        F.from_json(text, schemas.TAG_REPLY, {"allowSingleQuotes": "false"})))


def parse_replies(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(status, tags) from raw replies.

    status: (batch_id, n_rows, ok, error, n_tags); tags: (batch_id, R2 columns).
    """
    parsed = parse_reply_column(replies)
    status = parsed.select(
        "batch_id", "n_rows",
        (F.col("error").isNull() & F.col("_parsed").isNotNull()).alias("ok"),
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("_parsed").isNull(), F.lit("reply is not a JSON array of tags"))
        .alias("error"),
        F.coalesce(F.size("_parsed"), F.lit(0)).cast("long").alias("n_tags"),
    )
    tags = parsed.filter(F.col("error").isNull() & F.col("_parsed").isNotNull()).select(
        "batch_id", F.inline("_parsed"))
    return status, tags


def failure_stop(status: DataFrame, budget: int = cb.FAILURE_BUDGET) -> int | None:
    """Batch id at which a serial run stops: the ``budget``-th failed batch, or
    None when fewer batches failed. A distributed top-n; one number reaches
    the driver."""
    first_fails = (status.filter(~F.col("ok")).select("batch_id")
                   .orderBy("batch_id").limit(budget)
                   .agg(F.count(F.lit(1)).alias("n"), F.max("batch_id").alias("stop"))
                   .first())
    if first_fails is None or first_fails["n"] < budget:
        return None
    return int(first_fails["stop"])


def attach_tags(reviews: DataFrame, tags: DataFrame) -> DataFrame:
    """Inner join on ``reviewId = id`` (J1); both keys stay, repeated ids multiply."""
    return reviews.join(tags, reviews["reviewId"] == tags["id"], "inner")


def tag_coverage(reviews: DataFrame, tags: DataFrame) -> DataFrame:
    """What the inner join silently drops (J5): (kind, id)."""
    untagged = reviews.join(tags, reviews["reviewId"] == tags["id"], "left_anti").select(
        F.lit("untagged_review").alias("kind"), F.col("reviewId").alias("id"))
    unknown = tags.join(reviews, tags["id"] == reviews["reviewId"], "left_anti").select(
        F.lit("unknown_id").alias("kind"), F.col("id"))
    return untagged.unionByName(unknown)


def codebook_check(tags: DataFrame, tags_allowed: list[str] | None = None) -> DataFrame:
    """Tag rows outside the codebook (T7): (id, primary_tag, secondary_tag, sentiment,
    problem), one row per problem, in one pass. No secondary tag is no problem."""
    book = F.array(*[F.lit(t) for t in tags_allowed or cb.PRIMARY_TAGS])
    moods = F.array(*[F.lit(t) for t in cb.SENTIMENTS])

    def column(name: str, kind: str) -> F.Column:
        return F.col(name) if name in tags.columns else F.lit(None).cast(kind)

    second = column("secondary_tag", "string")
    found = F.array_compact(F.array(
        F.when(~F.coalesce(F.array_contains(book, F.col("primary_tag")), F.lit(False)),
               F.lit("unknown primary_tag")),
        F.when(second.isNotNull() & ~F.array_contains(book, second), F.lit("unknown secondary_tag")),
        F.when(~F.coalesce(F.array_contains(moods, F.col("sentiment")), F.lit(False)),
               F.lit("unknown sentiment")),
        F.when(F.col("id").isNull(), F.lit("missing id"))))
    return tags.select("id", "primary_tag", second.alias("secondary_tag"), "sentiment",
                       F.explode(found).alias("problem"))


def run_report(loaded: DataFrame, status: DataFrame, kept_tags: DataFrame,
               tagged: DataFrame) -> DataFrame:
    """Run summary as (metric, value) rows (A13) of tables that are there already: rows
    loaded, batches, failed batches, tags kept, rows tagged. The batches' status gives two
    of them in one scan; ``finish_run`` counts during the run instead."""
    n = F.count(F.lit(1))
    of_status = status.agg(n.alias("batches"), F.count_if(~F.col("ok")).alias("failed_batches")) \
        .unpivot([], ["batches", "failed_batches"], "metric", "value")
    out = loaded.agg(n.alias("value")).select(F.lit("rows_loaded").alias("metric"), "value") \
        .unionByName(of_status)
    for name, df in (("tags_kept", kept_tags), ("rows_tagged", tagged)):
        out = out.unionByName(df.agg(n.alias("value")).select(F.lit(name).alias("metric"), "value"))
    return out


def finish_run(job: dict, path: str, partition_by: str | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Write the tagged reviews of ``tag_reviews`` under ``path`` and the batches' status under
    ``<path>_batches``; return the run's summary, (metric, value) rows as ``run_report`` has
    them (A13).

    Nothing is read again to be counted: batches, their rows and their tags are counted as
    the status is written, tagged rows as they are written.
    """
    status, tagged = Observation(), Observation()
    base, n = path.rstrip("/"), F.count(F.lit(1))
    stopped = F.col("after_stop") if "after_stop" in job["status"].columns else F.lit(False)
    job["status"].observe(status, F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows_loaded"), n.alias("batches"), F.count_if(~F.col("ok")).alias("failed_batches"),
                          F.coalesce(F.sum(F.when(stopped, 0).otherwise(F.col("n_tags"))), F.lit(0)).alias("tags_kept")) \
        .write.mode("overwrite").parquet(f"{base}_batches")
    out = job["tagged"].drop(*drop).observe(tagged, n.alias("rows_tagged")).write.mode("overwrite")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    found = {**status.get, **tagged.get}
    order = ("rows_loaded", "batches", "failed_batches", "tags_kept", "rows_tagged")
    return job["status"].sparkSession.createDataFrame([(k, int(found[k])) for k in order], "metric string, value long")


def tag_reviews(reviews: DataFrame, tagger: Tagger, order_col="seq",
                size: int = cb.BATCH_SIZE, budget: int | None = None,
                parallelism: int | None = None, materialize: bool = True,
                replies_dir: str | None = None, run_id: str | None = None, wave: int = WAVE) -> dict[str, DataFrame]:
    """The whole job: returns ``batched``, ``replies``, ``status``, ``tags`` and
    ``tagged`` (reviews joined to the kept tags).

    Every batch that answers is kept. ``budget`` asks for the rows a serial run would have
    kept that stops at its ``budget``-th failure; the status then says which batches come
    after the stop (``after_stop``), and ``ok`` is null for those that were not called any
    more: calls end with the ``wave`` of batches in which the budget is used up.
    ``materialize=False`` skips the checkpoint; only for callers that read the tags exactly once.
    """
    batched = batch_rows(reviews, order_col, size)
    if budget is None:
        replies = call_tagger(batches(batched), tagger, parallelism, materialize=materialize,
                              replies_dir=replies_dir, run_id=run_id)
        status, tags = parse_replies(replies)
    else:
        replies, uncalled = call_in_waves(batches(batched), tagger, budget, wave, parallelism, replies_dir, run_id)
        status, tags = parse_replies(replies)
        stop = failure_stop(status, budget)
        status = status.unionByName(uncalled.withColumn("n_tags", F.lit(0).cast("long")), allowMissingColumns=True)
        status = status.withColumn("after_stop", F.lit(False) if stop is None
                                   else F.col("batch_id") >= F.lit(stop))
        tags = tags if stop is None else tags.filter(F.col("batch_id") < F.lit(stop))
    return {"batched": batched, "replies": replies, "status": status, "tags": tags,
            "tagged": attach_tags(reviews, tags)}


def tag_in_place(reviews: DataFrame, tagger: Tagger, size: int = cb.BATCH_SIZE,
                 id_col: str = "reviewId", text_col: str = "content") -> DataFrame:
    """Replies for batches cut within each partition, with no shuffle: (batch_id, n_rows,
    reply, error). For live rows, whose positions over the whole run don't matter."""
    def run(frames):
        from pyspark import TaskContext
        batch_id = TaskContext.get().partitionId() << 33
        for f in frames:
            done = []
            for at in range(0, len(f), size):
                rows = f[at:at + size].to_dict("records")
                done.append((batch_id, len(rows), *_ask_tagger(tagger, rows)))
                batch_id += 1
            yield pd.DataFrame(done, columns=schemas.BATCH_RESULT.names)

    return reviews.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")) \
        .mapInPandas(run, schemas.BATCH_RESULT)
