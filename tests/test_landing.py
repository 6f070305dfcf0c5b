"""Landings that share a table, input order of files, paged pulls, budget waves, strict
lists, running totals and bounded live state."""

import datetime as dt
import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from feedlens import cli, schemas
from feedlens.functions.lists import with_lists
from feedlens.operators import ordering, rules
from feedlens.operators import tagging as tg
from feedlens.sources import files, landing, threads
from feedlens.streaming import live
from test_threads import LONG, node, thread_doc


def rows(spark, source, ids, **columns):
    df = spark.createDataFrame([(f"{source or ''}{k}", f"text number {k} of this source", source) for k in ids],
                               "reviewId string, content string, source string")
    for name, value in columns.items():
        df = df.withColumn(name, value)
    return df


def landed(spark, path):
    return sorted((r.reviewId, r.source) for r in files.read_landed(spark, path).collect())


def test_landings_share_a_table(spark, tmp_dir):
    path = os.path.join(tmp_dir, "landed")
    files.land_table(rows(spark, "store", range(3), at=F.lit("2024-01-02 03:04:05").cast("timestamp")), path, ["store"])
    files.land_table(rows(spark, "forum", range(2), thread=F.lit("t1"), extra=F.lit(7)), path, ["forum"])
    both = [("forum0", "forum"), ("forum1", "forum"), ("store0", "store"), ("store1", "store"), ("store2", "store")]
    assert landed(spark, path) == both
    files.land_table(rows(spark, "store", [9]), path, ["store"])          # its own rows are replaced
    assert landed(spark, path) == both[:2] + [("store9", "store")]
    files.land_table(rows(spark, "store", []), path, ["store"])           # none left
    assert landed(spark, path) == both[:2]
    files.land_table(rows(spark, None, [1]).union(rows(spark, "a/b=c %", [2])), path)
    assert landed(spark, path) == sorted(both[:2] + [("1", None), ("a/b=c %2", "a/b=c %")], key=lambda r: r[0])
    files.land_table(rows(spark, "a/b=c %", []), path, ["a/b=c %"])
    assert len(landed(spark, path)) == 3
    back = files.read_landed(spark, path)
    assert back.columns == [f.name for f in schemas.LANDED.fields]
    assert dict(back.dtypes)["at"] == "timestamp_ntz"


def test_a_failed_landing_leaves_the_table(spark, tmp_dir):
    path = os.path.join(tmp_dir, "landed")
    files.land_table(rows(spark, "store", range(3)), path, ["store"])
    broken = rows(spark, "store", [1]).withColumn("score", F.raise_error(F.lit("cut off")).cast("double"))
    with pytest.raises(PySparkException):
        files.land_table(broken, path, ["store"])
    assert len(landed(spark, path)) == 3


def test_cli_landings_share_an_output(spark, tmp_dir):
    def at(name):
        return os.path.join(tmp_dir, name)

    play = [(f"r{k}", f"a review text that is long enough {k}", 3, k, dt.datetime(2024, 1, 1)) for k in range(9)]
    spark.createDataFrame(play, schemas.PLAY_EXPORT).write.parquet(at("play"))
    spark.createDataFrame([("https://f/comments/a/1/", thread_doc("A post title here", "body", [node("c1", LONG)]))],
                          "thread string, json string").write.parquet(at("threads"))
    for _ in range(2):
        cli.main(["land-play", "--input", at("play"), "--output", at("all"), "--target", "3", "--page-rows", "2"], spark=spark)
        cli.main(["land-threads", "--input", at("threads"), "--output", at("all")], spark=spark)
    got = files.read_landed(spark, at("all")).collect()
    assert sorted(r.reviewId for r in got) == ["c1", "p_A p", "r0", "r1", "r2", "r3"]
    assert sorted(r.seq for r in got if r.source == "play_store") == [0, 1, 2, 3]


# ---------------------------------------------------------------- input order

@pytest.mark.parametrize("fmt", ["parquet", "csv", "text"])
def test_input_order_does_not_depend_on_splits(spark, tmp_dir, fmt):
    """Equal ids and batches for any split planning, over files of unlike sizes."""
    path, want = os.path.join(tmp_dir, "in"), []
    for k, n in enumerate((700, 3, 0, 2000, 40)):
        part = spark.range(n).select(F.concat(F.lit(f"file {k} row "), F.col("id").cast("string"), F.lit(" of it")).alias("text"))
        if n:
            part.coalesce(1).write.mode("append").option("parquet.block.size", 4096).format(fmt).save(f"{path}/n={k}")
        want += [f"file {k} row {i} of it" for i in range(n)]
    found = []
    for size in ("1g", "20k", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        try:
            df = spark.read.format(fmt).load(path)
            df = df.withColumnRenamed(df.columns[0], "text").select("text")
            place = ordering.file_position(df)
            found.append(df.rdd.getNumPartitions())
            ids = tg.batch_rows(place, "position")
            got = {r.text: (r.idx, r.batch_id) for r in ids.collect()}
            assert got == {t: (k, k // 15) for k, t in enumerate(want)}
            up = landing.ingest_text_column(place, "text", "position")
            assert {r.content: r.reviewId for r in up.collect()} == {
                t: f"up_{k}" for k, t in enumerate(want) if len(t) > 20}
            stacked = landing.union_sources([place, place.drop("position").withColumn("seq", F.lit(None).cast("long"))])
            first = stacked.orderBy("source_no", "position").limit(len(want)).collect()
            assert [r.text for r in first] == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(set(found)) > 1


def test_input_seq_stands(spark):
    df = spark.createDataFrame([(5,), (3,)], "seq long")
    assert ordering.input_seq(df) is df


def test_union_order_of_a_shared_table(spark):
    """One table with several sources and rows without a place: by source, then seq."""
    shared = spark.createDataFrame([("b", 1, "b1"), ("a", 2, "a2"), ("b", 0, "b0"), ("a", 0, "a0"), ("c", None, "c")],
                                   "source string, seq long, reviewId string")
    got = landing.union_sources([shared]).orderBy("source_no", "position").collect()
    assert [r.reviewId for r in got] == ["c", "a0", "a2", "b0", "b1"]


# ---------------------------------------------------------------- running totals and pages

@pytest.mark.parametrize("buckets", [1, 3, 17])
def test_running_total(spark, buckets):
    rnd = random.Random(4)
    values = [(k, None if rnd.random() < 0.1 else rnd.randrange(100)) for k in range(500)]
    df = spark.createDataFrame(rnd.sample(values, len(values)), "k long, v long").repartition(5)
    got = {r.k: r.total for r in ordering.running_total(df, "k", "v", buckets=buckets).collect()}
    total = 0
    for k, v in values:
        total += v or 0
        assert got[k] == total
    assert ordering.running_total(df.limit(0), "k", "v").count() == 0


@pytest.mark.parametrize("n, page, target, kept", [(1000, 200, 300, 400), (1000, 200, 400, 400), (1000, 7, 300, 301),
                                                   (250, 200, 3000, 250), (0, 200, 3000, 0), (10, 200, 1, 10)])
def test_pull_pages(spark, n, page, target, kept):
    feed = spark.range(n).withColumn("seq", F.col("id") * 3).repartition(3)
    got = sorted(r.id for r in landing.pull_pages(feed, ("seq",), page, target).collect())
    assert got == list(range(kept))


def test_pull_stops_at_an_empty_page(spark):
    sizes = {0: 5, 1: 2, 3: 50, 9000: 4}
    feed = spark.createDataFrame([(p, k) for p, n in sizes.items() for k in range(n)], "page long, k long")

    def pages(target):
        return {r.page for r in landing.pull_pages(feed, target=target, page_col="page").collect()}

    assert pages(5) == {0} and pages(6) == {0, 1} and pages(3000) == {0, 1} and pages(60) == {0, 1}
    assert landing.pull_pages(feed.where("page > 0"), target=5, page_col="page").count() == 0


def test_thread_report_total(spark):
    docs = [(f"https://f/comments/{k}/x/", thread_doc("A post title that is long", "body", [node(f"c{k}_{i}", LONG) for i in range(k)]))
            for k in range(5)] + [("https://f/comments/9/x/", "{broken")]
    report = threads.thread_report(threads.parse_threads(spark.createDataFrame(docs, "thread string, json string")))
    got = [(r.ok, r.rows_kept, r.rows_total) for r in report.orderBy("thread").collect()]
    assert got == [(True, 1, 1), (True, 2, 3), (True, 3, 6), (True, 4, 10), (True, 5, 15), (False, 0, 15)]


# ---------------------------------------------------------------- failure budget in waves

class Counted:
    """Logs each call as a file; fails on the named first ids."""

    def __init__(self, folder, fail):
        self.folder, self.fail, self.inner = folder, set(fail), rules.RuleTagger()

    def __call__(self, batch):
        with open(os.path.join(self.folder, batch[0]["id"]), "a") as f:
            f.write("x")
        if batch[0]["id"] in self.fail:
            raise RuntimeError("model unavailable")
        return self.inner(batch)


def reviews(spark, n):
    return spark.range(n).selectExpr("concat('r', id) AS reviewId", "concat('great delivery, review number ', id) AS content",
                                     "id AS seq")


@pytest.mark.parametrize("wave", [1, 4, 1000])
def test_a_used_up_budget_stops_the_calls(spark, tmp_path, wave):
    calls = tmp_path / "calls"
    calls.mkdir()
    tagger = Counted(str(calls), {"r30", "r75", "r150"})                  # batches 2, 5 and 10 of 40
    job = tg.tag_reviews(reviews(spark, 600), tagger, budget=3, wave=wave)
    status = {r.batch_id: r for r in job["status"].collect()}
    called = min(40, -(-11 // wave) * wave)
    assert len(list(calls.iterdir())) == called and len(status) == 40
    assert [b for b in sorted(status) if status[b].ok is not None] == list(range(called))
    assert [b for b in sorted(status) if status[b].after_stop] == list(range(10, 40))
    assert sorted({r.batch_id for r in job["tags"].collect()}) == [0, 1, 3, 4, 6, 7, 8, 9]
    out = str(tmp_path / "tagged")
    report = {r.metric: r.value for r in tg.finish_run(job, out).collect()}
    assert report == {"rows_loaded": 600, "batches": 40, "failed_batches": 3, "tags_kept": 120, "rows_tagged": 120}
    assert spark.read.parquet(out).count() == 120 and spark.read.parquet(out + "_batches").count() == 40
    assert all(len(f.read_text()) == 1 for f in calls.iterdir())          # writing repeats no call


def test_waves_resume(spark, tmp_path):
    calls, replies = tmp_path / "calls", str(tmp_path / "replies")
    calls.mkdir()
    first = tg.tag_reviews(reviews(spark, 150), Counted(str(calls), {"r0", "r15"}), budget=2, wave=4,
                           replies_dir=replies, run_id="a")
    assert first["tags"].count() == 0
    whole = tg.tag_reviews(reviews(spark, 150), Counted(str(calls), ()), budget=2, wave=4, replies_dir=replies, run_id="a")
    assert whole["tags"].count() == 150 and not whole["status"].where("after_stop").count()
    assert {f.name: len(f.read_text()) for f in calls.iterdir()} == {
        "r0": 2, "r15": 2, **{f"r{k}": 1 for k in range(30, 150, 15)}}
    empty = tg.tag_reviews(reviews(spark, 0), Counted(str(calls), ()), budget=1)
    assert empty["status"].count() == 0 and empty["tags"].count() == 0


# ---------------------------------------------------------------- strict lists

def test_lists_strict_and_counted(spark):
    texts = ["['a', 'b']", None, "[]", "('c',)", "['d'", "nope", "5", "[u'e', r'f']"]
    df = spark.createDataFrame([(t,) for t in texts], "categories_mentioned string")
    seen = Observation()
    got = [r.items for r in with_lists(df, "categories_mentioned", "items", strict=False, seen=seen).collect()]
    assert got == [["a", "b"], None, [], ["c"], None, None, None, ["e", "f"]]
    assert seen.get == {"lists": 7, "bad_lists": 3, "bad_example": "5"}
    good = df.where("categories_mentioned IS NULL OR categories_mentioned LIKE '%]'")
    assert with_lists(good, "categories_mentioned").count() == 4
    with pytest.raises(PySparkException, match="not a list literal"):
        with_lists(df, "categories_mentioned").collect()


# ---------------------------------------------------------------- bounded live state

def test_live_state_is_bounded_and_exact(spark, tmp_dir):
    """Thirty days of deliveries, ids kept for two: repeats found, old reviews apart."""
    day0, text = dt.datetime(2024, 1, 1), "the milk was rotten and the bread stale"
    seen_ids, largest, provider = set(), 0, spark.conf.get(live._PROVIDER)
    want_late = set()
    landing_dir, out, ckpt = (os.path.join(tmp_dir, x) for x in ("in", "out", "ckpt"))
    for day in range(0, 30, 3):
        now = day0 + dt.timedelta(days=day)
        batch = [(f"n{day}_{k}", text, now - dt.timedelta(hours=k), k, now) for k in range(20)]           # new, on time
        batch += [(f"n{day}_0", text, now, 0, now), (f"o{day}", text, now - dt.timedelta(days=9), 0, now),  # a repeat, an old one
                  (f"u{day}", text, None, 0, now)]                                                         # and one without a time
        if day:                                                                                            # comes again, is old by then
            batch.append((f"n{day - 3}_1", text, now - dt.timedelta(days=3, hours=1), 1, now))
        want_late |= {f"o{day}", f"u{day}"}
        seen_ids |= {r[0] for r in batch}
        live.land_feed(spark.createDataFrame(batch, live.ARRIVED), f"{landing_dir}/d{day:02}", files=1)
        stream = live.feed_stream(spark, landing_dir + "/*", keep_seconds=2 * 86_400, arrived=True)
        q = live.start_live_run(stream, rules.RuleTagger(style="fenced_json"), out, ckpt, run_id="r")
        q.awaitTermination()
        assert q.exception() is None and live.state_figures(q)["dropped"] == 0
        largest = max(largest, live.state_figures(q)["ids"])
    tagged = [r.id for r in live.read_live(spark, out).collect()]
    late = [r.reviewId for r in live.read_late(spark, out).collect()]
    assert sorted(tagged) == sorted(f"n{d}_{k}" for d in range(0, 30, 3) for k in range(20))
    assert want_late <= set(late) and not set(late) & {x for x in seen_ids if x.startswith("n") and x not in tagged}
    assert all(x in want_late or x.endswith("_1") for x in late)
    assert 20 <= largest <= 75 < len(seen_ids)          # two days, and the delivery at hand, of 228 ids
    assert spark.conf.get(live._PROVIDER) == provider


# ---------------------------------------------------------------- large dumps

@pytest.mark.parametrize("size", ["1g", "64"])
def test_large_dumps_are_read_in_splits(spark, tmp_dir, size):
    """The numbers and texts of chunk_text, whatever the runs of line ends and the splits."""
    rnd = random.Random(8)
    texts = ["", "\n", "\n\n\n", "one", "one\n", "one\n\n", "\n\none", "\none\n\n\ntwo\n\n\n\n\nthree \n  \n four\r\n\r\nfive"]
    texts += ["".join(rnd.choice(["a b", "x", "\n", "\n\n", " ", "é\n"]) for _ in range(rnd.randrange(300))) for _ in range(6)]
    os.makedirs(os.path.join(tmp_dir, "dumps"))
    for k, t in enumerate(texts):
        with open(os.path.join(tmp_dir, "dumps", f"page{k}.txt"), "w", newline="") as f:
            f.write(t)
    whole = files.chunk_text(files.read_text_dumps(spark, os.path.join(tmp_dir, "dumps"))).where("content <> ''")
    want = sorted((r.file, r.idx, r.reviewId, r.content) for r in whole.collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = files.chunk_large_dumps(spark, os.path.join(tmp_dir, "dumps"))
        assert sorted((r.file, r.idx, r.reviewId, r.content) for r in got.collect()) == want and len(want) > 50
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


# ---------------------------------------------------------------- pulls of whole rows

def test_pull_does_not_range_the_rows(spark, monkeypatch):
    """Pages of one size: the last key is found over keys, ties and nulls counted as rows."""
    feed = spark.createDataFrame([(None if k < 3 else k // 10, f"t{k}") for k in range(200)], "seq long, text string")
    def none(*a, **k):
        raise AssertionError("the rows are ranged")

    with monkeypatch.context() as m:
        m.setattr(landing, "row_index", none)
        got = landing.pull_pages(feed.repartition(5), ("seq",), 4, 42).collect()
        assert len(got) == 44 and max(r.seq for r in got if r.seq is not None) == 4 and sum(r.seq is None for r in got) == 3
    monkeypatch.setattr(landing, "FEW_ROWS", 10)
    again = landing.pull_pages(feed.repartition(5), ("seq", "text"), 4, 42).collect()
    by = sorted(feed.collect(), key=lambda r: (-1 if r.seq is None else r.seq, r.text))[:44]
    assert sorted(r.text for r in again) == sorted(r.text for r in by)
