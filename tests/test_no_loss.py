"""Nothing is lost in silence: budgets, late rows, earlier runs, failed batches, deep
threads, CSV shape, source order, loose replies."""

import datetime as dt
import json
import os

import pytest

from feedlens.functions.text import not_deleted
from feedlens.operators import rules
from feedlens.operators import tagging as tg
from feedlens.sources import files, landing
from feedlens.sources import threads as thr
from feedlens.streaming import live
from test_threads import LONG, node, listing, thread_doc


class FailsOn:
    """Raises where a batch holds one of the ids."""

    def __init__(self, *ids):
        self.ids, self.inner = set(ids), rules.RuleTagger()

    def __call__(self, rows):
        if self.ids & {r["id"] for r in rows}:
            raise RuntimeError("model unavailable")
        return self.inner(rows)


class Logged:
    """Answers, and leaves a file for every call; the first calls fail where asked."""

    def __init__(self, folder, fail=()):
        self.folder, self.fail, self.inner = folder, set(fail), rules.RuleTagger()

    def __call__(self, rows):
        name = os.path.join(self.folder, rows[0]["id"])
        calls = os.path.exists(name)
        with open(name, "a") as f:
            f.write("x")
        if rows[0]["id"] in self.fail and not calls:
            raise RuntimeError("later")
        return self.inner(rows)


def many(spark, n):
    return spark.range(n).selectExpr("concat('r', id) AS reviewId",
                                     "concat('great delivery, review number ', id) AS content", "id AS seq")


def test_a_few_failed_batches_cost_only_themselves(spark):
    job = tg.tag_reviews(many(spark, 3000), FailsOn("r0", "r15", "r30"))
    assert job["tagged"].count() == 3000 - 45
    assert job["status"].filter("NOT ok").count() == 3
    capped = tg.tag_reviews(many(spark, 3000), FailsOn("r0", "r15", "r30"), budget=3)
    assert capped["tagged"].count() == 0
    assert capped["status"].filter("after_stop").count() == 200 - 2   # from the third failure on


def test_stored_replies_are_not_asked_for_again(spark, tmp_path):
    calls, out = tmp_path / "calls", str(tmp_path / "replies")
    calls.mkdir()
    tagger = Logged(str(calls), fail={"r15"})
    first = tg.tag_reviews(many(spark, 60), tagger, replies_dir=out, run_id="a")
    assert first["tagged"].count() == 45
    second = tg.tag_reviews(many(spark, 60), tagger, replies_dir=out, run_id="a")
    assert second["tagged"].count() == 60
    assert {f.name: len(f.read_text()) for f in calls.iterdir()} == {"r0": 1, "r15": 2, "r30": 1, "r45": 1}


def test_stored_replies_stand_for_equal_batches_only(spark, tmp_path):
    """A sample's short last batch, another batch size, shifted rows and another tagger."""
    out = str(tmp_path / "replies")

    def tagged(df, tagger=rules.RuleTagger(), **more):
        return {r.reviewId: r.primary_tag for r in
                tg.tag_reviews(df, tagger, replies_dir=out, run_id="a", **more)["tagged"].collect()}

    whole = many(spark, 40)
    assert len(tagged(whole.where("seq < 25"))) == 25
    every = tagged(whole)
    assert len(every) == 40
    assert tagged(whole, size=7) == every
    assert len(tagged(whole.where("seq >= 3"))) == 37
    assert set(tagged(whole, other_tagger).values()) == {"INFO_GAP"}
    assert tagged(whole) == every


def other_tagger(rows):
    return [{"id": r["id"], "primary_tag": "INFO_GAP", "sentiment": "mixed"} for r in rows]


def test_replies_are_read_strictly(spark):
    good = json.dumps([{"id": "a", "primary_tag": "INFO_GAP", "sentiment": "mixed"}])
    replies = [good, good + " That is all.", "Here: " + good, good.replace('"', "'"), good[1:-1], '"[]"', "[]", ""]
    df = spark.createDataFrame([(k, 1, r, None) for k, r in enumerate(replies)],
                               "batch_id long, n_rows long, reply string, error string")
    status, _ = tg.parse_replies(df)
    ok = {r.batch_id: r.ok for r in status.collect()}
    assert [ok[k] for k in range(len(replies))] == [True, False, False, False, False, False, True, False]


def test_codebook_check_covers_the_secondary_tag(spark):
    tags = spark.createDataFrame([("a", "INFO_GAP", "ODD", "mixed"), (None, "X", None, "meh"),
                                  ("b", "INFO_GAP", None, "mixed")],
                                 "id string, primary_tag string, secondary_tag string, sentiment string")
    got = sorted((str(r.id), r.problem) for r in tg.codebook_check(tags).collect())
    assert got == [("None", "missing id"), ("None", "unknown primary_tag"), ("None", "unknown sentiment"),
                   ("a", "unknown secondary_tag")]


def land(spark, folder, ids, at):
    rows = [(i, "great app love it, so fast", at, int(i)) for i in ids]
    live.land_feed(spark.createDataFrame(rows, live.LANDED), folder)


def test_live_runs_keep_late_rows_other_runs_and_status(spark, tmp_dir):
    a, out = os.path.join(tmp_dir, "a"), os.path.join(tmp_dir, "live")
    noon = dt.datetime(2024, 1, 2, 12)

    def run(source, name, tagger):
        q = live.start_live_run(live.feed_stream(spark, source + "/*"), tagger, out,
                                os.path.join(tmp_dir, "ckpt-" + name), run_id=name)
        q.awaitTermination()
        assert q.exception() is None

    land(spark, a + "/1", [str(i) for i in range(10)], noon)
    run(a, "first", rules.RuleTagger())
    land(spark, a + "/2", [str(i) for i in range(5, 20)], noon - dt.timedelta(days=1))  # late, some known
    run(a, "first", rules.RuleTagger())
    assert sorted(int(r.id) for r in live.read_live(spark, out).collect()) == list(range(20))
    b = os.path.join(tmp_dir, "b")
    land(spark, b + "/1", [str(i) for i in range(100, 103)], noon)
    run(b, "second", FailsOn("101"))
    kept = live.read_live(spark, out)
    assert kept.filter("run_id = 'first'").count() == 20             # the first run's rows stay
    failed = live.read_live_batches(spark, out).filter("NOT ok").collect()
    assert len(failed) == 1 and failed[0].run_id == "second" and "unavailable" in failed[0].error
    assert kept.filter("run_id = 'second'").count() + failed[0].n_rows == 3


def test_a_retried_epoch_reuses_its_replies(spark, tmp_path):
    calls, a, out = tmp_path / "calls", str(tmp_path / "a"), str(tmp_path / "live")
    calls.mkdir()
    land(spark, a + "/1", ["1", "2"], dt.datetime(2024, 1, 1))
    for ckpt in ("c1", "c2"):          # a lost checkpoint runs epoch 0 of the run again
        q = live.start_live_run(live.feed_stream(spark, a + "/*"), Logged(str(calls)), out,
                                str(tmp_path / ckpt), run_id="r")
        q.awaitTermination()
    assert live.read_live(spark, out).count() == 2
    assert sum(len(f.read_text()) for f in calls.iterdir()) <= 2


@pytest.mark.parametrize("depth", [200, 1000, 5000])
def test_threads_of_any_depth(spark, depth):
    text = '""'
    for k in range(depth, 0, -1):
        data = json.dumps({"id": f"c{k}", "body": f"{LONG} {k}", "created_utc": 1700000000})
        text = ('{"kind":"Listing","data":{"children":[{"kind":"t1","data":' + data[:-1] + ', "replies":'
                + text + "}}]}}")
    post = json.dumps(listing([{"kind": "t3", "data": {"id": "p", "title": "A title long enough",
                                                       "selftext": "x\\\"[{", "created_utc": 1}}]))
    docs = spark.createDataFrame([("t", f"[{post},{text}]"), ("bad", "[1,"), ("none", None),
                                  ("flat", thread_doc("Another title, long enough", "", [node("z", LONG)]))],
                                 "thread string, json string")
    parsed = thr.parse_threads(docs)
    rows = thr.land_threads(parsed).collect()
    assert len([r for r in rows if r.thread == "t"]) == depth + 1
    rep = {r.thread: (r.ok, r.posts_kept, r.comments_kept) for r in thr.thread_report(parsed).collect()}
    assert rep == {"t": (True, 1, depth), "bad": (False, 0, 0), "none": (False, 0, 0), "flat": (True, 1, 1)}


def test_stack_parser_reads_what_the_standard_one_reads():
    for doc in ({"a": [1, -2.5e3, None, True, "x\\\"]{, é"], "b": {}, "c": [[], [{}]]}, [], "s", 3):
        text = json.dumps(doc, indent=1)
        standard, json.loads = json.loads, lambda t, first=[True]: _raise_once(t, first, standard)
        try:
            assert thr.load_json(text) == doc
        finally:
            json.loads = standard
    for bad in ("[1", "[1]]", '{"a" 1', "[1}", "[x]"):
        with pytest.raises(ValueError):
            thr.load_json(bad)


def _raise_once(text, first, standard):
    if first[0]:
        first[0] = False
        raise RecursionError
    return standard(text)


def test_removed_comments_are_not_kept(spark):
    df = spark.createDataFrame([("[deleted]",), ("[removed]",), ("",), (None,), ("kept",)], "content string")
    assert [r.content for r in df.filter(not_deleted("content")).collect()] == ["kept"]


def test_csv_columns_are_found_by_name_and_text_keeps_its_blanks(spark, tmp_dir):
    path = os.path.join(tmp_dir, "hand.csv")
    with open(path, "w") as f:
        f.write('other,your_tag,content,reviewId\n1,JUNK,"  padded, text  ",r1\n2, spaced ,"two\nlines",r2\n')
    from feedlens import schemas
    rows = {r.reviewId: r for r in files.read_reviews_csv(spark, path, schemas.BLIND).collect()}
    assert rows["r1"].content == "  padded, text  " and rows["r1"].your_tag == "JUNK"
    assert rows["r2"].content == "two\nlines" and rows["r2"].your_tag == " spaced "
    short = files.read_reviews_csv(spark, path)                    # columns that the file lacks are null
    assert short.filter("primary_tag IS NULL AND thumbsUpCount IS NULL").count() == 2
    with open(path, "w") as f:
        f.write("content,your_tag\nx,y\n")
    with pytest.raises(ValueError, match="reviewId"):
        files.read_reviews_csv(spark, path, schemas.BLIND)
    out = os.path.join(tmp_dir, "out.csv")
    files.write_table(spark.createDataFrame([("r", "  both sides  ")], "reviewId string, content string"), out,
                      fmt="csv", partition_by=None)
    assert files.read_reviews_csv(spark, out, schemas.BLIND).first().content == "  both sides  "


def test_sources_with_and_without_an_order_keep_the_stack_order(spark):
    play = spark.createDataFrame([(f"p{i}", "play text long enough here") for i in range(20)],
                                 "reviewId string, content string").coalesce(1)
    ios = spark.createDataFrame([(f"i{i}", "ios text long enough here", 100 - i) for i in range(20)],
                                "reviewId string, content string, seq long").repartition(4)
    stacked = landing.union_sources([ios, play])
    rows = tg.batch_rows(stacked, ("source_no", "position")).orderBy("idx").collect()
    assert [r.reviewId for r in rows] == [f"i{i}" for i in reversed(range(20))] + [f"p{i}" for i in range(20)]
    assert [r.idx for r in rows] == list(range(40)) and rows[15].batch_id == 1


def test_rule_words_match_whole_words(spark):
    texts = ["chocolate on a plate for breakfast, wiping the carpet", "it came late", "price comparison", "pet food, so fast"]
    tagger = rules.RuleTagger()
    one = [tagger.tag_one(str(k), t) for k, t in enumerate(texts)]
    assert one[0]["categories_mentioned"] == [] and one[0]["sentiment"] == "mixed"
    assert one[1]["sentiment"] == "negative" and one[2]["primary_tag"] == "PRICE_VALUE"
    assert one[3]["categories_mentioned"] == ["pet"] and one[3]["sentiment"] == "positive"
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    for r in df.select("k", rules.rule_tag("t").alias("x")).collect():
        assert r.x.asDict() == {k: v for k, v in one[r.k].items() if k != "id"}
