"""Batch tagging job (T1-T7, P4-P6, J1, J5, A13) with invented taggers (F-F)."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens.operators import rules
from feedlens.operators import tagging as tg


def reviews(spark, n=100):
    rows = [(f"r{i}", f"review number {i} " + ("rotten vegetables" if i % 7 == 0 else
                                              "great fast delivery"), i * 3) for i in range(n)]
    return spark.createDataFrame(rows, "reviewId string, content string, seq long")


class FailingTagger:
    """Fails on the listed batches (by first id); answers like the rule tagger otherwise."""

    def __init__(self, bad_first_ids, style="plain"):
        self.bad = set(bad_first_ids)
        self.inner = rules.RuleTagger(style=style)

    def __call__(self, rows):
        if rows[0]["id"] in self.bad:
            raise RuntimeError("model unavailable")
        return self.inner(rows)


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_batches_do_not_depend_on_partitioning(spark, parts):
    df = reviews(spark).repartition(parts)
    b = {r.reviewId: (r.idx, r.batch_id) for r in tg.batch_rows(df).collect()}
    assert b["r0"] == (0, 0) and b["r14"] == (14, 0) and b["r15"] == (15, 1)
    assert b["r99"] == (99, 6)


def test_render_prompt(spark):
    p = tg.render_prompt(tg.batch_rows(reviews(spark, 16))).orderBy("batch_id").collect()
    assert p[0].n_rows == 15 and p[1].n_rows == 1
    assert p[1].prompt == "ID: r15\nREVIEW: review number 15 great fast delivery"
    assert p[0].prompt.count("\n\nID: ") == 14


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_job_matches_sql_rule_tagger(spark, parts):
    df = reviews(spark).repartition(parts)
    job = tg.tag_reviews(df, rules.RuleTagger(style="fenced_json"))
    got = {r.reviewId: (r.primary_tag, r.sentiment, tuple(r.categories_mentioned))
           for r in job["tagged"].collect()}
    want = {r.reviewId: (r.t.primary_tag, r.t.sentiment, tuple(r.t.categories_mentioned))
            for r in df.select("reviewId", rules.rule_tag("content").alias("t")).collect()}
    assert got == want and len(got) == 100
    assert got["r0"][0] == "TRUST_QUALITY" and got["r1"][0] == "SERVICE_NOISE"


def test_failed_batches_are_isolated_and_budgeted(spark):
    df = reviews(spark)
    tagger = FailingTagger({"r15", "r45", "r75"})  # batches 1, 3, 5 fail
    job = tg.tag_reviews(df, tagger, budget=None)
    status = {r.batch_id: r for r in job["status"].collect()}
    assert [b for b, s in sorted(status.items()) if not s.ok] == [1, 3, 5]
    assert "model unavailable" in status[1].error
    assert job["tags"].count() == 100 - 45
    capped = tg.tag_reviews(df, tagger, budget=3)
    # the third failure (batch 5) stops a serial run: batches 0, 2 and 4 were tagged
    assert sorted({r.batch_id for r in capped["tags"].collect()}) == [0, 2, 4]
    assert tg.tag_reviews(df, FailingTagger({"r15", "r45"}), budget=3)["tags"].count() == 70


def test_reply_shapes(spark):
    full = [{"id": "a", "primary_tag": "PRICE_VALUE", "secondary_tag": None,
             "categories_mentioned": ["milk"], "explored_new": True, "sentiment": "mixed"}]
    short = [{"id": "b", "primary_tag": "INFO_GAP", "categories_mentioned": [],
              "sentiment": "negative", "extra": 1}]
    replies = [
        (0, 1, json.dumps(full), None),
        (1, 1, "```json\n" + json.dumps(short) + "\n```", None),
        (2, 1, "```\n" + json.dumps(full) + "\n```", None),
        (3, 1, '[{"id": "c", "primary_tag": "TRUST', None),    # truncated
        (4, 1, "Sorry, I cannot tag these.", None),            # prose
        (5, 1, None, "TimeoutError: slow"),
    ]
    df = spark.createDataFrame(replies, "batch_id long, n_rows long, reply string, error string")
    status, tags = tg.parse_replies(df)
    ok = {r.batch_id: r.ok for r in status.collect()}
    assert ok == {0: True, 1: True, 2: True, 3: False, 4: False, 5: False}
    t = {(r.batch_id, r.id): r for r in tags.collect()}
    assert t[(1, "b")].secondary_tag is None and t[(1, "b")].explored_new is None
    assert t[(0, "a")].categories_mentioned == ["milk"]


def test_join_coverage_and_codebook(spark):
    revs = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "reviewId string, content string")
    tags = spark.createDataFrame(
        [("a", "PRICE_VALUE", "positive"), ("a", "PRICE_VALUE", "positive"),
         ("zz", "NOT_A_TAG", "positive"), ("b", "INFO_GAP", "angry")],
        "id string, primary_tag string, sentiment string")
    joined = tg.attach_tags(revs, tags)
    assert joined.filter(F.col("reviewId") == "a").count() == 2   # repeated id multiplies
    assert joined.filter(F.col("reviewId") == "zz").count() == 0  # invented id vanishes
    cov = sorted((r.kind, r.id) for r in tg.tag_coverage(revs, tags).collect())
    assert cov == [("unknown_id", "zz"), ("untagged_review", "c")]
    bad = sorted((r.id, r.problem) for r in tg.codebook_check(tags).collect())
    assert bad == [("b", "unknown sentiment"), ("zz", "unknown primary_tag")]


def test_tagger_may_return_parsed_tags(spark):
    inner = rules.RuleTagger()
    job = tg.tag_reviews(reviews(spark, 20), lambda rows: [inner.tag_one(r["id"], r["text"])
                                                           for r in rows])
    assert job["tagged"].count() == 20


def test_empty_input_gives_empty_outputs(spark):
    df = reviews(spark).filter("false")
    job = tg.tag_reviews(df, rules.RuleTagger())
    assert job["status"].count() == 0 and job["tagged"].count() == 0
    rep = {r.metric: r.value for r in
           tg.run_report(df, job["status"], job["tags"], job["tagged"]).collect()}
    assert rep["rows_loaded"] == 0 and rep["batches"] == 0


def test_run_report(spark):
    df = reviews(spark, 30)
    job = tg.tag_reviews(df, FailingTagger({"r15"}), budget=None)
    rep = {r.metric: r.value for r in
           tg.run_report(df, job["status"], job["tags"], job["tagged"]).collect()}
    assert rep == {"rows_loaded": 30, "batches": 2, "failed_batches": 1, "tags_kept": 15,
                   "rows_tagged": 15}


def test_a_batch_crosses_to_python_review_by_review(spark):
    """No row that Python reads holds a whole batch; nulls, failures and batches that span two
    Arrow frames come back as before, an empty batch as well."""
    seen = T.StructType([T.StructField("idx", T.LongType()), T.StructField("id", T.StringType()), T.StructField("text", T.StringType())])
    rows = [(b, n, [(k, f"{b}_{k}", None if k == 3 else f"great app {k}") for k in range(n)]) for b, n in ((0, 15), (1, 15), (2, 4), (3, 0))]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("batch_id", T.LongType()), T.StructField("n_rows", T.LongType()),
                                                   T.StructField("rows", T.ArrayType(seen))])).coalesce(1)
    def answers(batch):
        if any(r["id"] == "1_0" for r in batch):
            raise ValueError("no")
        return [r["id"] + ("-" if r["text"] is None else "") for r in batch]

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        out = tg.call_tagger(df, answers, materialize=False)
        got = {r.batch_id: (r.n_rows, r.error, r.reply and json.loads(r.reply)) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {b: (n, None, [f"{b}_{k}" + ("-" if k == 3 else "") for k in range(n)]) for b, n, _ in rows}
    assert got == {**want, 1: (15, "ValueError: no", None)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" in plan and "MapInArrow" in plan
