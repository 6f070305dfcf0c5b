"""Registered queries for validation (X5, V1-V5), file import/export (S1, S11,
P7) and the live stream (S12), with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from feedlens.functions.lists import parse_list, with_lists
from feedlens.operators import rules
from feedlens.operators import validation as val
from feedlens.plans import analogues as an
from feedlens.plans.analog_rules import ANALOG_BOOK
from feedlens.plans.oracle import MENTIONS, ORACLE, TAGGED_ROWS, subst, trim_u
from feedlens.plans.queries import register
from feedlens.plans.tagging_queries import TAGGER, rule_tag_sql
from feedlens.session import scratch_path
from feedlens.sources import files
from feedlens.streaming import live


def tagged_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document reviews with their rule tags (R3 over documents)."""
    r = an.reviews(spark, sf_dir)
    t = r.withColumn("_t", rules.rule_tag(F.col("content"), ANALOG_BOOK))
    return t.select(*[c for c in r.columns if c != "seq"], F.col("reviewId").alias("id"),
                    "_t.*", "seq")


def _coded(spark, sf_dir):
    docs = tagged_docs(spark, sf_dir)
    blind = an.human_tags(spark, sf_dir).join(docs.select("reviewId", "content"), "reviewId")
    return val.coded(blind, val.answer_key(docs))


@register("validation_sample")
def q_validation_sample(spark, sf_dir):
    """Blind copy of the seeded 50-row sample."""
    s = val.blind_copy(val.validation_sample(tagged_docs(spark, sf_dir)))
    return s.select("reviewId", "content",
                    "your_tag")


@register("answer_key")
def q_answer_key(spark, sf_dir):
    """Answer key of the same sample (V2)."""
    return val.answer_key(val.validation_sample(tagged_docs(spark, sf_dir)))


@register("agreement")
def q_agreement(spark, sf_dir):
    """Human codes (labels) against machine tags."""
    return val.agreement(_coded(spark, sf_dir))


@register("disagreements")
def q_disagreements(spark, sf_dir):
    """Where human and machine differ, whole text (V4)."""
    return val.disagreements(_coded(spark, sf_dir), None)


@register("confusion")
def q_confusion(spark, sf_dir):
    """Scored rows per (human, machine) tag pair (V5)."""
    return val.confusion(_coded(spark, sf_dir))


@register("src_reviews")
def q_src_reviews(spark, sf_dir):
    """Tagged reviews exported as the reference's CSV, then read back."""
    docs = tagged_docs(spark, sf_dir)
    literal = F.concat(F.lit("["), F.array_join(F.transform(
        "categories_mentioned", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    export = docs.select(
        "reviewId", "content", "score", "thumbsUpCount", "at", "source", "thread", "id",
        "primary_tag", "secondary_tag", literal.alias("categories_mentioned"),
        F.when(F.col("explored_new"), F.lit("True")).otherwise(F.lit("False"))
        .alias("explored_new"),
        "sentiment")
    path = scratch_path(spark, "csv")
    files.write_table(export, path, fmt="csv", partition_by=None)
    back = files.read_reviews_csv(spark, path)
    return back.select("reviewId", "content",
                       "source", "primary_tag", "secondary_tag",
                       F.array_join("categories_mentioned", "|").alias("categories"),
                       "explored_new", "sentiment")


@register("parse_list")
def q_parse_list(spark, sf_dir):
    """Category lists written as Python literals in three styles, parsed back.

    Reviews of fully shipped orders (positive) use single quotes, open orders
    (negative) JSON, partly shipped orders (mixed) a tuple of prefixed strings.
    """
    parsed = _literals(spark, sf_dir).select("reviewId", parse_list("literal").alias("items"))
    # The outer form avoids an inferred filter that would run the parser twice.
    return (parsed.select("reviewId", F.posexplode_outer("items").alias("pos", "item"))
            .filter(F.col("pos").isNotNull())
            .select("reviewId", F.col("pos").cast("long").alias("pos"), "item"))


@register("list_report")
def q_list_report(spark, sf_dir):
    """Mentions per category of lists as written, with the broken ones counted in the same
    pass (P7, A5). Lists of orders whose number divides by 50 lack their closing bracket."""
    t = _literals(spark, sf_dir)
    order = F.substring_index("reviewId", "-", 1).cast("long")
    cut = F.when(order % 50 == 0, F.substring("literal", F.lit(1), F.length("literal") - 1)).otherwise(F.col("literal"))
    seen = Observation()
    lists = with_lists(t.select(cut.alias("literal")), "literal", "items", strict=False, seen=seen)
    path = scratch_path(spark, "list-report")
    lists.select(F.explode_outer("items").alias("category")).where("category is not null") \
        .groupBy("category").agg(F.count(F.lit(1)).alias("mentions")).write.parquet(path)
    found = seen.get
    counts = spark.read.schema("category string, mentions long").parquet(path)
    return counts.unionByName(spark.createDataFrame(
        [(f"({k})", found[k]) for k in ("lists", "bad_lists")], "category string, mentions long"))


def _literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reviewId and literal: each review's categories as one of three list literals."""
    t = an.tagged(spark, sf_dir).select("reviewId", "sentiment", "categories_mentioned")
    c = F.col("categories_mentioned")

    def quoted(q):  # q + items joined by q, q + q: no lambda, stays in generated code
        return F.concat(F.lit(q), F.array_join(c, f"{q[-1]}, {q}"), F.lit(q[-1]))

    lit = (F.when(F.size(c) == 0, F.lit("[]"))
           .when(F.col("sentiment") == "positive",
                 F.concat(F.lit("["), quoted("'"), F.lit("]")))
           .when(F.col("sentiment") == "negative",
                 F.concat(F.lit("["), quoted('"'), F.lit("]")))
           .otherwise(F.concat(F.lit("("), quoted("u'"), F.lit(",)"))))
    return t.select("reviewId", lit.alias("literal"))


@register("write_table")
def q_write_table(spark, sf_dir):
    """Tagged corpus written partitioned by source, all sources read back."""
    path = scratch_path(spark, "tagged")
    files.write_table(an.tagged(spark, sf_dir), path)
    return spark.read.parquet(path).select(
        "reviewId", "primary_tag", "source", "content",
        F.array_join("categories_mentioned", "|").alias("categories"))


@register("live_run")
def q_live_run(spark, sf_dir):
    """New store reviews tagged as a stream, kept apart from the corpus (S12, F12). They land
    scattered over files by their users, out of time order, and every fifth review lands twice,
    in another file."""
    feed = an.play_export(spark, sf_dir).select("reviewId", "content", "at", "seq")
    feed = feed.union(feed.where("seq % 5 = 0"))
    landing = live.land_feed(feed, scratch_path(spark, "landing"), rows_per_file=25_000)
    stream = live.feed_stream(spark, landing)
    out = scratch_path(spark, "live_tagged")
    q = live.start_live_run(stream, TAGGER, out, scratch_path(spark, "live_ckpt"),
                            run_id="live")
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    res = live.read_live(spark, out)
    return res.select(F.col("id").alias("reviewId"), "primary_tag",
                      F.array_join("categories_mentioned", "|").alias("categories"),
                      "sentiment", "run_id")


KEEP_DAYS = 3


@register("live_bounded")
def q_live_bounded(spark, sf_dir):
    """Three deliveries of store reviews, each tagged by a run that goes on from the last, with
    ids kept for three days (S12). A review arrives as many days after it was written as its
    number leaves modulo 5; every seventh arrives once more a day later. Those older than
    three days on arrival go apart."""
    day = F.lit(86_400).cast("long")
    feed = an.play_export(spark, sf_dir).select("reviewId", "content", F.col("at").cast("timestamp").alias("at"), "seq")

    def after(days: F.Column) -> F.Column:
        return F.timestamp_seconds(F.unix_micros("at").cast("decimal(20,0)") / 1_000_000 + days * day)

    feed = feed.withColumn("arrived", after(F.col("seq") % 5))
    feed = feed.union(feed.where("seq % 7 = 0").withColumn("arrived", after(F.col("seq") % 5 + 1)))
    feed = feed.withColumn("at", F.col("at").cast("timestamp_ntz"))
    ends = feed.agg(F.min(F.unix_micros("arrived")).alias("lo"), F.max(F.unix_micros("arrived")).alias("hi")).first()
    lo, third = ends["lo"] or 0, ((ends["hi"] or 0) - (ends["lo"] or 0)) // 3 + 1
    part = F.floor((F.unix_micros("arrived") - F.lit(lo)) / third)
    landing, out, ckpt = (scratch_path(spark, f"bounded-{k}") for k in ("in", "out", "ckpt"))
    for k in range(3):
        live.land_feed(feed.where(part == k), f"{landing}/delivery={k}", rows_per_file=25_000)
        stream = live.feed_stream(spark, f"{landing}/*", keep_seconds=KEEP_DAYS * 86_400, arrived=True)
        q = live.start_live_run(stream, TAGGER, out, ckpt, run_id="live")
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
        if live.state_figures(q)["dropped"]:
            raise RuntimeError("rows were dropped by the watermark")
    tagged = live.read_live(spark, out).select(F.col("id").alias("reviewId"), F.lit(False).alias("late"), "primary_tag")
    late = live.read_late(spark, out).select("reviewId", "late", F.lit(None).cast("string").alias("primary_tag"))
    return tagged.unionByName(late)


# --- SQL twins -------------------------------------------------------------------

DOCS_TAGGED = f"""
docs AS (
  SELECT CAST(doc_id AS VARCHAR) AS reviewId, text AS content, source, {rule_tag_sql('text')}
  FROM documents
)"""

SAMPLE = f"""
{DOCS_TAGGED},
sample AS (SELECT * FROM docs ORDER BY md5('42:' || reviewId), reviewId LIMIT 50)"""

HUMAN = f"""
human AS (
  SELECT CAST(doc_id AS VARCHAR) AS reviewId,
         CASE WHEN toxic = 1 AND quality = 0 THEN NULL
              WHEN toxic = 1 THEN ' junk'
              WHEN quality = 1 THEN 'service_noise'
              ELSE 'Trust_Quality ' END AS your_tag
  FROM labels
),
coded AS (
  SELECT h.reviewId, upper({trim_u('h.your_tag')}) AS your_tag, d.primary_tag, d.content,
         upper({trim_u('h.your_tag')}) IS NOT DISTINCT FROM 'JUNK' AS is_junk,
         upper({trim_u('h.your_tag')}) IS NOT DISTINCT FROM d.primary_tag AS agrees
  FROM human h JOIN docs d ON h.reviewId = d.reviewId
)"""

ORACLE["validation_sample"] = f"""
WITH {SAMPLE}
SELECT reviewId, content, '' AS your_tag FROM sample"""

ORACLE["answer_key"] = f"""
WITH {SAMPLE}
SELECT reviewId, primary_tag FROM sample"""

ORACLE["agreement"] = f"""
WITH {DOCS_TAGGED}, {HUMAN}
SELECT CAST(count(*) FILTER (WHERE is_junk) AS BIGINT) AS junk_rows,
       CAST(count(*) FILTER (WHERE NOT is_junk AND agrees) AS BIGINT) AS agree,
       CAST(count(*) FILTER (WHERE NOT is_junk) AS BIGINT) AS scored,
       CASE WHEN count(*) FILTER (WHERE NOT is_junk) = 0 THEN NULL
            ELSE CAST(count(*) FILTER (WHERE NOT is_junk AND agrees) AS DOUBLE)
                 / CAST(count(*) FILTER (WHERE NOT is_junk) AS DOUBLE) END AS agreement
FROM coded"""

ORACLE["disagreements"] = f"""
WITH {DOCS_TAGGED}, {HUMAN}
SELECT reviewId, your_tag, primary_tag, content
FROM coded WHERE NOT is_junk AND NOT agrees"""

ORACLE["confusion"] = f"""
WITH {DOCS_TAGGED}, {HUMAN}
SELECT your_tag, primary_tag, CAST(count(*) AS BIGINT) AS reviews
FROM coded WHERE NOT is_junk GROUP BY your_tag, primary_tag"""

ORACLE["src_reviews"] = f"""
SELECT CAST(doc_id AS VARCHAR) AS reviewId, text AS content,
       source, {rule_tag_sql('text')}
FROM documents"""

ORACLE["parse_list"] = f"""
WITH {TAGGED_ROWS}, {MENTIONS}
SELECT reviewId, pos, category_raw AS item FROM mentions"""

ORACLE["list_report"] = f"""
WITH {TAGGED_ROWS}, {MENTIONS},
cut AS (SELECT *, CAST(split_part(reviewId, '-', 1) AS BIGINT) % 50 = 0 AS bad FROM mentions)
SELECT category_raw AS category, CAST(count(*) AS BIGINT) AS mentions FROM cut WHERE NOT bad GROUP BY category_raw
UNION ALL SELECT '(lists)', CAST(count(*) AS BIGINT) FROM tagged
UNION ALL SELECT '(bad_lists)', CAST(count(*) AS BIGINT) FROM tagged WHERE CAST(split_part(reviewId, '-', 1) AS BIGINT) % 50 = 0"""

ORACLE["live_bounded"] = f"""
SELECT reviewId, event_id % 5 > {KEEP_DAYS} AS late,
       CASE WHEN event_id % 5 <= {KEEP_DAYS} THEN primary_tag END AS primary_tag FROM (
  SELECT CAST(e.event_id AS VARCHAR) AS reviewId, e.event_id, {rule_tag_sql('d.text')}
  FROM events e JOIN documents d ON e.user_id = d.doc_id
  WHERE {subst('d.text')})"""

ORACLE["write_table"] = f"""
WITH {TAGGED_ROWS}
SELECT reviewId, primary_tag, source, content, p_name || '|' || noun AS categories FROM tagged"""

ORACLE["live_run"] = f"""
SELECT reviewId, primary_tag, categories, sentiment, 'live' AS run_id FROM (
  SELECT CAST(e.event_id AS VARCHAR) AS reviewId, {rule_tag_sql('d.text')}
  FROM events e JOIN documents d ON e.user_id = d.doc_id
  WHERE {subst('d.text')})"""
