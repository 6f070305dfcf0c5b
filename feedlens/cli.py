"""Command-line jobs, one per step of the feedback workflow.

    python -m feedlens land-play     --input exports/play    --output landed/play
    python -m feedlens land-appstore --input exports/ios     --output landed/ios [--limit 400]
    python -m feedlens land-threads  --input threads.parquet --output landed/forum
    python -m feedlens land-dumps    --input dumps/          --output landed/pasted
    python -m feedlens tag           --input landed/play --input landed/forum --output tagged
    python -m feedlens report        --input tagged [--tag TRUST_QUALITY ...]
    python -m feedlens panels        --input tagged
    python -m feedlens sample        --input tagged --blind blind.csv --key key.csv
    python -m feedlens agreement     --blind coded.csv --key key.csv
    python -m feedlens live          --landing incoming/ --output live_tagged --checkpoint ckpt/

    python -m feedlens upload        --input table/ --column text [--order id] --output landed/up
    python -m feedlens paste         --input texts/ --column text --order id --output landed/own
    python -m feedlens newest        --input exports/play --n 60 --output landed/newest

Landings may share one ``--output`` folder: each replaces only its own source there.
Inputs and outputs are Parquet folders, or CSV when the path ends in ``.csv``.
Every job runs on the session's cluster. A report writes each of its tables whole under
``--output``; without it the first ``--head`` rows of each are printed, with a note where
there are more.
"""

from __future__ import annotations

import argparse
import importlib
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens import codebook as cb
from feedlens import schemas
from feedlens.operators import categories, filters, metrics, rules, tagging, validation
from feedlens.operators.ordering import file_position, input_seq, row_index
from feedlens.session import scratch_path
from feedlens.sources import files, landing, threads
from feedlens.streaming import live

PANELS = [("freshness", "TRUST_QUALITY", "perishable"),
          ("authenticity", "TRUST_AUTHENTICITY", "nonperishable")]


def read(spark: SparkSession, path: str, csv_schema=schemas.TAGGED_CSV) -> DataFrame:
    if path.endswith(".csv"):
        return files.read_reviews_csv(spark, path, csv_schema)
    return spark.read.parquet(path)


def write(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    if path.endswith(".csv"):
        files.write_table(df, path, fmt="csv", partition_by=None)
    else:
        files.write_table(df, path, partition_by=partition_by)


def land(df: DataFrame, path: str, source: str) -> None:
    """Landed rows beside those of other sources in ``path``; a CSV file holds one landing."""
    if path.endswith(".csv"):
        write(df.drop("seq"), path)
    else:
        files.land_table(df, path, [source])


def cmd_land_play(spark, a):
    feed = input_seq(read(spark, a.input[0], schemas.PLAY_EXPORT))
    if a.target:
        feed = landing.pull_pages(feed, page_rows=a.page_rows, target=a.target)
    land(landing.land_play(feed), a.output, "play_store")


def cmd_land_appstore(spark, a):
    df = input_seq(read(spark, a.input[0], schemas.APPSTORE_EXPORT))
    land(landing.land_appstore(df, limit=a.limit), a.output, "app_store")


def emit(df: DataFrame, name: str, a) -> None:
    """One table of a report: written whole under ``--output``, or its first ``--head`` rows
    printed, with a note where there are more."""
    if a.output:
        write(df, f"{a.output.rstrip('/')}/{name}")
        return
    print(f"-- {name}: {', '.join(df.columns)}")
    rows = df.take(a.head + 1)
    for row in rows[:a.head]:
        print("\t".join("" if v is None else str(v) for v in row))
    if len(rows) > a.head:
        print(f"   the first {a.head} rows; --output writes all of them")


def load_tagger(name: str | None):
    """The tagger ``module:callable`` names (a class is called without arguments); the rule
    tagger without a name."""
    if not name:
        return rules.RuleTagger()
    module, _, attribute = name.partition(":")
    found = getattr(importlib.import_module(module), attribute)
    return found() if isinstance(found, type) else found


def cmd_land_threads(spark, a):
    # The nodes are read by the landing and by the report: parsed once, kept once.
    path = scratch_path(spark, "thread-nodes")
    threads.parse_threads(read(spark, a.input[0])).write.parquet(path)
    parsed = spark.read.parquet(path)
    rows = row_index(threads.land_threads(parsed), ("thread", "path"), "seq")
    land(rows.drop("path"), a.output, "reddit")
    write(threads.thread_report(parsed), a.output.rstrip("/") + "_threads")


def cmd_upload(spark, a):
    df = read(spark, a.input[0])
    if a.order is None:                            # the order of the input files
        df = file_position(df, "_position")
    out = landing.ingest_text_column(df, a.column, a.order or "_position", cap=a.limit)
    land(out.withColumnRenamed("idx", "seq"), a.output, "upload")


def cmd_paste(spark, a):
    out = landing.ingest_lines(read(spark, a.input[0]), a.column, a.order, cap=a.limit)
    land(out, a.output, "paste")


def cmd_newest(spark, a):
    rows = landing.land_play(landing.newest_reviews(read(spark, a.input[0], schemas.PLAY_EXPORT), a.n))
    land(rows, a.output, "play_store")


def cmd_scores(spark, a):
    emit(metrics.score_distribution(read(spark, a.input[0])), "scores", a)


def cmd_land_dumps(spark, a):
    rows = files.land_dumps(files.read_text_dumps(spark, a.input[0]))
    land(row_index(rows, ("thread", "idx"), "seq").drop("idx"), a.output, "reddit_manual")


def cmd_tag(spark, a):
    corpus = landing.union_sources([file_position(read(spark, p, schemas.REVIEWS_CSV)) for p in a.input])
    if a.first:
        corpus = filters.first_n(corpus, a.first, ("source_no", "position"))
    out = a.output.rstrip("/")
    run_id = a.run_id or uuid.uuid4().hex[:8]
    print(f"run id: {run_id}")                     # restarts the run, if given as --run-id
    job = tagging.tag_reviews(corpus, load_tagger(a.tagger), ("source_no", "position"),
                              size=a.batch_size, budget=a.budget, wave=a.wave, parallelism=a.parallelism,
                              replies_dir=out + "_replies", run_id=run_id)
    report = tagging.finish_run(job, a.output, "source", drop=("source_no", "position", "seq"))
    metrics.tag_counts(spark.read.parquet(a.output)).show(len(cb.PRIMARY_TAGS) + 1, truncate=False)
    report.show(truncate=False)


def cmd_report(spark, a):
    t = read(spark, a.input[0])
    emit(metrics.tag_by_source(t), "tag_by_source", a)
    c = categories.category_counts_raw_by_tag(t, a.tag or ["TRUST_QUALITY", "TRUST_AUTHENTICITY"])
    emit(c.orderBy("primary_tag", F.col("mentions").desc(), "category"), "categories", a)
    gold = filters.gold_rows(t)
    print(f"gold rows: {gold.count()}")
    emit(gold, "gold_rows", a)


def cmd_panels(spark, a):
    t = read(spark, a.input[0])
    emit(metrics.noise_split(t), "noise_split", a)
    emit(metrics.signal_tag_counts(t), "signal_tags", a)
    emit(categories.category_panels(t, PANELS).orderBy("panel", "rank"), "panels", a)
    emit(categories.panel_mentions(t, PANELS), "mentions", a)


def cmd_sample(spark, a):
    s = validation.validation_sample(read(spark, a.input[0]), a.n, a.seed)
    write(validation.blind_copy(s), a.blind)
    write(validation.answer_key(s), a.key)


def cmd_agreement(spark, a):
    blind = read(spark, a.blind, schemas.BLIND)
    key = read(spark, a.key, schemas.KEY)
    coded = validation.coded(blind, key)
    emit(validation.agreement(coded), "agreement", a)
    emit(validation.disagreements(coded), "disagreements", a)


def cmd_live(spark, a):
    stream = live.feed_stream(spark, a.landing, keep_seconds=a.keep_seconds)
    run_id = a.run_id or uuid.uuid4().hex[:8]
    q = live.start_live_run(stream, load_tagger(a.tagger), a.output, a.checkpoint,
                            run_id=run_id, available_now=not a.continuous)
    q.awaitTermination()
    if not a.continuous:
        done = live.read_live_batches(spark, a.output).where(F.col("run_id") == run_id)
        done.groupBy("ok").agg(F.count("*").alias("batches"), F.sum("n_rows").alias("reviews")).show()
        metrics.tag_counts(live.read_live(spark, a.output).where(F.col("run_id") == run_id)) \
            .show(len(cb.PRIMARY_TAGS) + 1, truncate=False)
        if a.keep_seconds is not None:
            late = live.read_late(spark, a.output).where(F.col("run_id") == run_id)
            print(f"late reviews, under {a.output.rstrip('/')}_landed: {late.count()}; state: {live.state_figures(q)}")


COMMANDS = {
    "land-play": cmd_land_play, "land-appstore": cmd_land_appstore,
    "land-threads": cmd_land_threads, "land-dumps": cmd_land_dumps,
    "tag": cmd_tag, "report": cmd_report, "panels": cmd_panels,
    "sample": cmd_sample, "agreement": cmd_agreement, "live": cmd_live,
    "upload": cmd_upload, "paste": cmd_paste, "newest": cmd_newest, "scores": cmd_scores,
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="feedlens")
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("--input", action="append", default=[])
    p.add_argument("--output")
    p.add_argument("--limit", type=int)
    p.add_argument("--target", type=int, help="keep whole pages of the feed until this many rows are pulled")
    p.add_argument("--page-rows", type=int, default=200)
    p.add_argument("--tag", action="append")
    p.add_argument("--head", type=int, default=200, help="rows of a report's table to print without --output")
    p.add_argument("--batch-size", type=int, default=cb.BATCH_SIZE)
    p.add_argument("--budget", type=int, help="stop where a serial run would, at its N-th failed batch")
    p.add_argument("--wave", type=int, default=tagging.WAVE,
                   help="with --budget: batches called between two looks at the failures")
    p.add_argument("--tagger", help="module:callable, rows -> reply text; the rule tagger by default")
    p.add_argument("--run-id", help="a restarted run of the same id repeats no stored call of an unchanged batch; a new id without it")
    p.add_argument("--first", type=int, help="tag only the first N rows in input order")
    p.add_argument("--column")
    p.add_argument("--order")
    p.add_argument("--parallelism", type=int,
                   help="at most this many tagger calls at once (partitions of the batches)")
    p.add_argument("--n", type=int, default=cb.SAMPLE_SIZE)
    p.add_argument("--seed", type=int, default=cb.SAMPLE_SEED)
    p.add_argument("--blind")
    p.add_argument("--key")
    p.add_argument("--landing")
    p.add_argument("--checkpoint")
    p.add_argument("--keep-seconds", type=int, help="live: keep ids so long after they arrived; older reviews go apart")
    p.add_argument("--continuous", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if spark is None:
        spark = SparkSession.builder.appName(f"feedlens-{a.command}").getOrCreate()
    COMMANDS[a.command](spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
