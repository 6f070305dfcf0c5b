"""Registered queries of the classification job
and their SQL twins. The job runs with the rule tagger, whose rules the SQL
restates, so every step of the batch path has an oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens import codebook as cb
from feedlens.operators import filters as flt
from feedlens.operators import rules
from feedlens.operators import tagging as tg
from feedlens.plans import analogues as an
from feedlens.plans.analog_rules import ANALOG_BOOK, FaultyTagger
from feedlens.plans.oracle import ORACLE, subst
from feedlens.plans.queries import register
from feedlens.session import scratch_path

TAGGER = rules.RuleTagger(ANALOG_BOOK, style="fenced_json")
FAULTY = FaultyTagger(ANALOG_BOOK)
ANALOG_TAGS = [t for t, _ in ANALOG_BOOK.rules] + [ANALOG_BOOK.default_tag]


def _input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagging input: substantive document reviews, in doc_id order."""
    return flt.substantive(an.reviews(spark, sf_dir))


def _job(spark: SparkSession, sf_dir: str, budget=None, tagger=TAGGER):
    return tg.tag_reviews(_input(spark, sf_dir), tagger, order_col="seq", budget=budget)


def _tag_cols(df: DataFrame | None = None) -> list:
    return ["primary_tag", "secondary_tag",
            F.array_join("categories_mentioned", "|").alias("categories"),
            "explored_new", "sentiment"]


@register("rule_tagger")
def q_rule_tagger(spark, sf_dir):
    """The rule tagger in Spark SQL, over every document."""
    r = an.reviews(spark, sf_dir)
    t = r.select("reviewId", rules.rule_tag(F.col("content"), ANALOG_BOOK).alias("t"))
    return t.select("reviewId", "t.*").select("reviewId", *_tag_cols(t))


@register("batch_rows")
def q_batch_rows(spark, sf_dir):
    """Consecutive batches of 15 in input order."""
    return tg.batch_rows(_input(spark, sf_dir)).select("reviewId", "idx", "batch_id")


@register("render_prompt")
def q_render_prompt(spark, sf_dir):
    """One prompt block per batch, whole texts."""
    return tg.render_prompt(tg.batch_rows(_input(spark, sf_dir)), preview_chars=None)


@register("tag_partitions")
def q_tag_partitions(spark, sf_dir):
    """The batch job end to end: tagged reviews."""
    tagged = _job(spark, sf_dir)["tagged"]
    return tagged.select("reviewId", "id", "batch_id", *_tag_cols(tagged))


@register("parse_response")
def q_parse_response(spark, sf_dir):
    """Fenced replies to tag rows."""
    job = _job(spark, sf_dir)
    _, tags = tg.parse_replies(job["replies"])
    return tags.select("batch_id", "id", *_tag_cols(tags))


@register("batch_status")
def q_batch_status(spark, sf_dir):
    """One status row per batch, of a tagger that fails and babbles (T4)."""
    return _job(spark, sf_dir, tagger=FAULTY)["status"]


@register("failure_budget")
def q_failure_budget(spark, sf_dir):
    """Tags kept under a budget of three failed batches (T5)."""
    return _job(spark, sf_dir, budget=3, tagger=FAULTY)["tags"].select("batch_id", "id", "primary_tag")


@register("budget_calls")
def q_budget_calls(spark, sf_dir):
    """Which batches are called at all when waves of 8 batches share a budget of three
    failures (T5)."""
    status = tg.tag_reviews(_input(spark, sf_dir), FAULTY, order_col="seq", budget=3, wave=8)["status"]
    return status.select("batch_id", "n_rows", F.col("ok").isNotNull().alias("called"),
                         F.coalesce("ok", F.lit(False)).alias("ok"), "after_stop")


@register("attach_tags")
def q_attach_tags(spark, sf_dir):
    """Every document review joined to its tag."""
    tags = _job(spark, sf_dir)["tags"]
    return tg.attach_tags(an.reviews(spark, sf_dir), tags).select(
        "reviewId", "id", "source", "primary_tag")


@register("tag_coverage")
def q_tag_coverage(spark, sf_dir):
    """Reviews without a tag and tags without a review."""
    tags = _job(spark, sf_dir, tagger=FAULTY)["tags"]
    return tg.tag_coverage(an.reviews(spark, sf_dir), tags)


@register("codebook_check")
def q_codebook_check(spark, sf_dir):
    """Tags outside the codebook."""
    return tg.codebook_check(_job(spark, sf_dir, tagger=FAULTY)["tags"], ANALOG_TAGS)


@register("run_report")
def q_run_report(spark, sf_dir):
    """Rows loaded, batches, failures, tags kept, rows tagged, counted as they pass."""
    return tg.finish_run(_job(spark, sf_dir, tagger=FAULTY), scratch_path(spark, "run"))


# --- SQL twins -------------------------------------------------------------------

def _any(low: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({low}, '{w}')" for w in words) + ")"


def rule_tag_sql(text: str, book=ANALOG_BOOK) -> str:
    low = f"lower(coalesce({text}, ''))"
    fired = "list_filter([" + ", ".join(
        f"CASE WHEN {_any(low, ws)} THEN '{tag}' END" for tag, ws in book.rules
    ) + "], lambda x: x IS NOT NULL)"
    cats = "list_filter([" + ", ".join(f"'{w}'" for w in book.categories) + \
        f"], lambda w: contains({low}, w))"
    pos, neg = _any(low, book.positive), _any(low, book.negative)
    return (f"coalesce(({fired})[1], '{book.default_tag}') AS primary_tag, "
            f"({fired})[2] AS secondary_tag, "
            f"array_to_string({cats}, '|') AS categories, "
            f"{_any(low, book.explored)} AS explored_new, "
            f"CASE WHEN {pos} AND {neg} THEN 'mixed' WHEN {pos} THEN 'positive' "
            f"WHEN {neg} THEN 'negative' ELSE '{book.default_sentiment}' END AS sentiment")


INPUT = f"""
input AS (
  SELECT CAST(doc_id AS VARCHAR) AS reviewId, doc_id, text, source,
         CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS idx
  FROM documents WHERE {subst('text')}
),
batched AS (SELECT *, CAST(floor(idx / 15) AS BIGINT) AS batch_id FROM input),
tags AS (SELECT reviewId AS id, batch_id, {rule_tag_sql('text')} FROM batched)"""

ORACLE["rule_tagger"] = f"""
SELECT CAST(doc_id AS VARCHAR) AS reviewId, {rule_tag_sql('text')} FROM documents"""

ORACLE["batch_rows"] = f"""
WITH {INPUT}
SELECT reviewId, idx, batch_id FROM batched"""

ORACLE["render_prompt"] = f"""
WITH {INPUT}
SELECT batch_id, CAST(count(*) AS BIGINT) AS n_rows,
       string_agg('ID: ' || reviewId || chr(10) || 'REVIEW: ' || coalesce(text, 'nan'),
                  chr(10) || chr(10) ORDER BY idx) AS prompt
FROM batched GROUP BY batch_id"""

ORACLE["tag_partitions"] = f"""
WITH {INPUT}
SELECT id AS reviewId, id, batch_id, primary_tag, secondary_tag, categories, explored_new,
       sentiment
FROM tags"""

ORACLE["parse_response"] = f"""
WITH {INPUT}
SELECT batch_id, id, primary_tag, secondary_tag, categories, explored_new, sentiment FROM tags"""

# The rules of FaultyTagger.
FAULTY_TAGS = f"""
{INPUT},
judged AS (
  SELECT *, first_doc % 11 = 0 AS raised, first_doc % 11 <> 0 AND first_doc % 13 = 0 AS babbled
  FROM (SELECT *, first_value(doc_id) OVER (PARTITION BY batch_id ORDER BY idx) AS first_doc FROM batched)
),
faulty AS (
  SELECT CASE WHEN j.doc_id % 23 = 0 THEN t.id || 'x' ELSE t.id END AS id, j.batch_id,
         CASE WHEN j.doc_id % 17 = 0 THEN 'OFF_BOOK' ELSE t.primary_tag END AS primary_tag,
         CASE WHEN j.doc_id % 29 = 0 THEN 'ODD' ELSE t.secondary_tag END AS secondary_tag,
         CASE WHEN j.doc_id % 19 = 0 THEN 'meh' ELSE t.sentiment END AS sentiment
  FROM judged j JOIN tags t ON j.reviewId = t.id WHERE NOT raised AND NOT babbled
)"""

ORACLE["batch_status"] = f"""
WITH {FAULTY_TAGS}
SELECT batch_id, CAST(count(*) AS BIGINT) AS n_rows, NOT bool_or(raised OR babbled) AS ok,
       CASE WHEN bool_or(raised) THEN 'RuntimeError: model unavailable'
            WHEN bool_or(babbled) THEN 'reply is not a JSON array of tags' END AS error,
       CAST(CASE WHEN bool_or(raised OR babbled) THEN 0 ELSE count(*) END AS BIGINT) AS n_tags
FROM judged GROUP BY batch_id"""

ORACLE["failure_budget"] = f"""
WITH {FAULTY_TAGS},
failed AS (SELECT DISTINCT batch_id FROM judged WHERE raised OR babbled ORDER BY batch_id LIMIT 3),
stop AS (SELECT CASE WHEN count(*) = 3 THEN max(batch_id) END AS at FROM failed)
SELECT f.batch_id, f.id, f.primary_tag FROM faulty f, stop WHERE stop.at IS NULL OR f.batch_id < stop.at"""

ORACLE["budget_calls"] = f"""
WITH {FAULTY_TAGS},
by_batch AS (SELECT batch_id, count(*) AS n_rows, NOT bool_or(raised OR babbled) AS ok FROM judged GROUP BY batch_id),
failed AS (SELECT batch_id FROM by_batch WHERE NOT ok ORDER BY batch_id LIMIT 3),
stop AS (SELECT CASE WHEN count(*) = 3 THEN max(batch_id) END AS at FROM failed)
SELECT batch_id, CAST(n_rows AS BIGINT) AS n_rows,
       stop.at IS NULL OR batch_id // 8 <= stop.at // 8 AS called,
       ok AND (stop.at IS NULL OR batch_id // 8 <= stop.at // 8) AS ok,
       coalesce(batch_id >= stop.at, FALSE) AS after_stop
FROM by_batch, stop"""

ORACLE["attach_tags"] = f"""
WITH {INPUT}
SELECT CAST(d.doc_id AS VARCHAR) AS reviewId, t.id, d.source, t.primary_tag
FROM documents d JOIN tags t ON CAST(d.doc_id AS VARCHAR) = t.id"""

ORACLE["tag_coverage"] = f"""
WITH {FAULTY_TAGS}
SELECT 'untagged_review' AS kind, CAST(d.doc_id AS VARCHAR) AS id
FROM documents d WHERE CAST(d.doc_id AS VARCHAR) NOT IN (SELECT id FROM faulty)
UNION ALL
SELECT 'unknown_id', id FROM faulty WHERE id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents)"""

_BOOK = ", ".join(f"'{t}'" for t in ANALOG_TAGS)
_MOODS = ", ".join(f"'{t}'" for t in cb.SENTIMENTS)

ORACLE["codebook_check"] = f"""
WITH {FAULTY_TAGS}
SELECT id, primary_tag, secondary_tag, sentiment, 'unknown primary_tag' AS problem
FROM faulty WHERE primary_tag NOT IN ({_BOOK})
UNION ALL
SELECT id, primary_tag, secondary_tag, sentiment, 'unknown secondary_tag'
FROM faulty WHERE secondary_tag IS NOT NULL AND secondary_tag NOT IN ({_BOOK})
UNION ALL
SELECT id, primary_tag, secondary_tag, sentiment, 'unknown sentiment'
FROM faulty WHERE sentiment NOT IN ({_MOODS})"""

ORACLE["run_report"] = f"""
WITH {FAULTY_TAGS}
SELECT 'rows_loaded' AS metric, CAST(count(*) AS BIGINT) AS value FROM input
UNION ALL SELECT 'batches', CAST(count(DISTINCT batch_id) AS BIGINT) FROM batched
UNION ALL SELECT 'failed_batches', CAST(count(DISTINCT batch_id) AS BIGINT) FROM judged WHERE raised OR babbled
UNION ALL SELECT 'tags_kept', CAST(count(*) AS BIGINT) FROM faulty
UNION ALL SELECT 'rows_tagged', CAST(count(*) AS BIGINT) FROM faulty f JOIN input i ON f.id = i.reviewId"""
