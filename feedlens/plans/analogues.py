"""Views over the driver's test tables that stand in for the reference's inputs.

The test tables are a TPC-H-like star schema plus text tables. Each function
here derives one relation of the feedback data model from them, so every
registered query reads the given tables and its work grows with them:

* ``tagged``        R3 from lineitem x part x orders x customer (one row per order line)
* ``reviews``       R1 from documents
* ``store_feed``    store exports (F-E) from events x documents
* ``human_tags``    filled-in blind copies from labels
* ``thread_docs``   R6 thread JSON from conversations (turn k replies to turn k-1)

Every mapping below is a plain, fixed rule; the oracle SQL repeats it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed analogue mappings (repeated verbatim in plans/oracle.py).
# ---------------------------------------------------------------------------
PRIORITY_TAG = {
    "1-URGENT": "TRUST_QUALITY",
    "2-HIGH": "TRUST_AUTHENTICITY",
    "3-MEDIUM": "PRICE_VALUE",
    "4-NOT SPECIFIED": "MENTAL_MODEL",
    "5-LOW": "SERVICE_NOISE",
}
STATUS_SENTIMENT = {"F": "positive", "O": "negative", "P": "mixed"}
STATUS_SECONDARY = {"P": "INFO_GAP"}
EVENT_SCORE = {"error": 1, "click": 2, "view": 3, "signup": 4, "purchase": 5}
# Part names play the categories: aliases fold variants, a noun set is "perishable".
ANALOG_ALIASES = {
    "hot plate": "plate",
    "red plate": "plate",
    "cold gear": "gear",
    "new gear": "gear",
    "old rod": "rod",
    "hot rod": "rod",
    "blue ring": "ring",
    "red ring": "ring",
}
ANALOG_PERISHABLE = [
    "plate", "gear", "rod", "ring",
    "cold anvil", "cold bolt", "hot gizmo", "small widget", "large bolt",
]
# TPC-H market segments, lower-cased, play the review sources.
MARKET_SEGMENTS = ["automobile", "building", "furniture", "household", "machinery"]
# Thread documents: 2024-01-01 00:00 UTC as epoch seconds, and the URL stem.
THREAD_EPOCH = 1704067200
THREAD_URL = "https://forum.example.com/r/feedback/comments/"
# ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(col: str, mapping: dict):
    """CASE col WHEN k THEN v ... END (null when no key matches)."""
    expr = None
    for k, v in mapping.items():
        expr = (F.when(F.col(col) == F.lit(k), F.lit(v)) if expr is None
                else expr.when(F.col(col) == F.lit(k), F.lit(v)))
    return expr


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3 analogue: one tagged review per order line.

    reviewId = id = (order, line, part, supplier), which is unique; the review
    mentions two categories, its part's name and the name's last word (its
    noun), so an alias can make one review count a category twice, as in the
    reference. Tag from the order priority (5-LOW is the noise tag), source =
    the customer's market segment, explored_new = the order fully shipped.
    Every row comes from joins on keys; nothing is grouped, so no order or
    customer, however large, becomes one record.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey",
                                                 "l_linenumber")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                              "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    j = (li.join(part, li.l_partkey == part.p_partkey, "inner")
         .join(o, li.l_orderkey == o.o_orderkey, "inner")
         .join(c, o.o_custkey == c.c_custkey, "inner"))
    rid = F.concat_ws("-", *[F.col(k).cast("string") for k in
                             ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    noun = F.substring_index(F.col("p_name"), " ", -1)
    return j.select(
        rid.alias("reviewId"),
        F.concat(F.lit("order "), F.col("l_orderkey").cast("string"), F.lit(" by "),
                 F.col("c_name"), F.lit(": the "), F.col("p_name"), F.lit(", a "),
                 noun).alias("content"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("score"),
        F.lit(None).cast("long").alias("thumbsUpCount"),
        F.col("o_orderdate").alias("at"),
        F.lower(F.col("c_mktsegment")).alias("source"),
        F.lit(None).cast("string").alias("thread"),
        rid.alias("id"),
        _case("o_orderpriority", PRIORITY_TAG).alias("primary_tag"),
        _case("o_orderstatus", STATUS_SECONDARY).alias("secondary_tag"),
        F.array(F.col("p_name"), noun).alias("categories_mentioned"),
        (F.col("o_orderstatus") == F.lit("F")).alias("explored_new"),
        _case("o_orderstatus", STATUS_SENTIMENT).alias("sentiment"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 analogue from documents, with ``seq`` = doc_id as the input order."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("reviewId"),
        F.col("text").alias("content"),
        F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("long").alias("thumbsUpCount"),
        F.lit(None).cast("timestamp_ntz").alias("at"),
        F.col("source"),
        F.lit(None).cast("string").alias("thread"),
        F.col("doc_id").alias("seq"),
    )


def store_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store feed rows: each event is a review whose text is its user's document.

    Columns: event_id, ts, user_id, event_type, score, content.
    """
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return (ev.join(docs, ev.user_id == docs.doc_id, "inner")
            .select("event_id", "ts", "user_id", "event_type",
                    _case("event_type", EVENT_SCORE).cast("int").alias("score"),
                    F.col("text").alias("content")))


def play_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Play Store export (reviewId, content, score, thumbsUpCount, at) + seq."""
    f = store_feed(spark, sf_dir)
    return f.select(F.col("event_id").cast("string").alias("reviewId"), "content",
                    "score", F.col("user_id").alias("thumbsUpCount"),
                    F.col("ts").alias("at"), F.col("event_id").alias("seq"))


def appstore_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """App Store export (id, content, rating, date) + seq."""
    f = store_feed(spark, sf_dir)
    return f.select(F.col("event_id").cast("string").alias("id"), "content",
                    F.col("score").alias("rating"), F.col("ts").alias("date"),
                    F.col("event_id").alias("seq"))


def human_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled-in blind copy (reviewId, your_tag) from labels.

    toxic and low quality -> null (an unanswered row), toxic -> ' junk',
    good quality -> 'service_noise' (lower case), else 'Trust_Quality ' (padded).
    """
    lab = table(spark, sf_dir, "labels")
    tag = (F.when((F.col("toxic") == 1) & (F.col("quality") == 0), F.lit(None).cast("string"))
           .when(F.col("toxic") == 1, F.lit(" junk"))
           .when(F.col("quality") == 1, F.lit("service_noise"))
           .otherwise(F.lit("Trust_Quality ")))
    return lab.select(F.col("doc_id").cast("string").alias("reviewId"), tag.alias("your_tag"))


# --- forum threads and page dumps from conversations ---------------------------
# A conversation is a thread; its turn 0 is the post (title "thread <conv_id>",
# text as self text, likes = conv_id), every later turn replies to the turn
# before it (likes = turn, none for system turns); times are THREAD_EPOCH +
# conv_id hours + turn minutes.


def _thread_url(conv_id):
    return F.concat(F.lit(THREAD_URL), conv_id.cast("string"), F.lit("/conversation_"),
                    conv_id.cast("string"), F.lit("/"))


def thread_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thread of every conversation."""
    return table(spark, sf_dir, "conversations").select(_thread_url(F.col("conv_id")).alias("thread")).distinct()


def thread_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6 analogue: one thread document (thread URL, JSON text) per conversation.

    The nested reply chain of a conversation is one JSON text, as long as its turns; a
    thread document is one record of the source format, like a fetched page.
    """
    cv = table(spark, sf_dir, "conversations")
    conv = F.col("conv_id")
    created = (F.lit(THREAD_EPOCH) + conv * 3600 + F.col("turn") * 60).cast("long")
    post_json = F.to_json(F.struct(
        F.concat(F.lit("p"), conv.cast("string")).alias("id"),
        F.concat(F.lit("thread "), conv.cast("string")).alias("title"),
        F.col("text").alias("selftext"),
        conv.alias("ups"),
        created.alias("created_utc")))
    node_json = F.to_json(F.struct(
        F.concat(F.lit("c"), conv.cast("string"), F.lit("_"), F.col("turn").cast("string"))
        .alias("id"),
        F.col("text").alias("body"),
        F.when(F.col("role") != F.lit("system"), F.col("turn")).alias("ups"),
        created.alias("created_utc")))
    rows = cv.select("conv_id", "turn",
                     F.when(F.col("turn") == 0, post_json).alias("post"),
                     F.when(F.col("turn") > 0, F.struct("turn", node_json.alias("dj")))
                     .alias("node"))
    per_conv = rows.groupBy("conv_id").agg(
        F.max("post").alias("post"),
        F.array_sort(F.collect_list("node")).alias("nodes"))

    # Each node opens before and closes after all its replies, so a chain is the openings,
    # one after the other, and as many closings: its text is put together once.
    def opening(x):
        return F.concat(F.lit('{"kind":"t1","data":'), F.substring(x["dj"], F.lit(1), F.length(x["dj"]) - 1),
                        F.lit(',"replies":'))

    chain = F.when(F.size("nodes") == 0, F.lit("")).otherwise(F.concat(
        F.array_join(F.transform("nodes", opening), '{"kind":"Listing","data":{"children":['),
        F.lit('""}}'), F.expr("repeat(']}}}}', size(nodes) - 1)")))
    post_children = F.coalesce(F.concat(F.lit('{"kind":"t3","data":'), F.col("post"), F.lit("}")),
                               F.lit(""))
    doc = F.concat(F.lit('[{"kind":"Listing","data":{"children":['), post_children,
                   F.lit(']}},{"kind":"Listing","data":{"children":['), chain, F.lit("]}}]"))
    return per_conv.select(_thread_url(conv).alias("thread"), doc.alias("json"))


def write_conversation_dumps(spark: SparkSession, sf_dir: str, path: str) -> str:
    """Page-dump analogue: one text file per conversation, ``thread<conv_id>.txt``,
    holding its turns in order, each followed by a blank line.

    Rows are streamed to the file one turn at a time (each row is written as
    text + newline, and the text carries one more newline), so no conversation
    is ever assembled in memory.
    """
    cv = table(spark, sf_dir, "conversations")
    lines = cv.select(
        F.concat(F.lit("thread"), F.col("conv_id").cast("string"), F.lit(".txt")).alias("thread"),
        F.col("turn"),
        F.concat(F.col("text"), F.lit("\n")).alias("value"))
    # An explicit partition count: AQE would otherwise fold this small shuffle
    # into one task that writes every file alone.
    n = max(spark.sparkContext.defaultParallelism,
            int(spark.conf.get("spark.sql.shuffle.partitions")))
    (lines.repartition(n, "thread").sortWithinPartitions("thread", "turn")
     .select("thread", "value")
     .write.mode("overwrite").partitionBy("thread").text(path))
    return path


def write_large_dumps(spark: SparkSession, sf_dir: str, path: str, files: int = 4) -> str:
    """A few large page dumps: conversation after conversation in file number ``conv_id %
    files``, each turn followed by a blank line."""
    cv = table(spark, sf_dir, "conversations")
    name = F.concat(F.lit("dump"), (F.col("conv_id") % files).cast("string"), F.lit(".txt"))
    lines = cv.select(name.alias("thread"), "conv_id", "turn", F.concat(F.col("text"), F.lit("\n")).alias("value"))
    (lines.repartition(files, "thread").sortWithinPartitions("thread", "conv_id", "turn")
     .select("thread", "value").write.mode("overwrite").partitionBy("thread").text(path))
    return path
