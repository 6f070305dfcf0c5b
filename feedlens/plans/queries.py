"""Registered queries: one per operator of the inventory, over the test tables.

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names equal those of the matching SQL in ``plans/oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.operators import categories as cat
from feedlens.operators import filters as flt
from feedlens.operators import metrics as met
from feedlens.operators import ordering as ordr
from feedlens.functions.text import thread_slug
from feedlens.session import scratch_path
from feedlens.sources import files
from feedlens.sources import landing as land
from feedlens.sources import threads as thr
from feedlens.plans import analogues as an

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# --- categories (flagship) --------------------------------------------------

PANELS = [
    ("freshness", "TRUST_QUALITY", "perishable"),
    ("authenticity", "TRUST_AUTHENTICITY", "nonperishable"),
]


@register("category_top_k")
def q_category_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which categories does each fear sit in: the two dashboard panels."""
    top = cat.category_panels(an.tagged(spark, sf_dir), PANELS, aliases=an.ANALOG_ALIASES,
                              perishable=an.ANALOG_PERISHABLE)
    return top.select("panel", "primary_tag", "category",
                      F.col("mentions").cast("long").alias("mentions"),
                      F.col("reviews").cast("long").alias("reviews"), "rank")


@register("category_counts_raw")
def q_category_counts_raw(spark, sf_dir):
    """Mentions per category as written, for the two tags the reports print (A5)."""
    return cat.category_counts_raw_by_tag(an.tagged(spark, sf_dir),
                                          ["TRUST_QUALITY", "TRUST_AUTHENTICITY"])


@register("shown_mentions")
def q_shown_mentions(spark, sf_dir):
    """Mentions behind each panel's top 8 (A7) next to all mentions of the panel."""
    return cat.panel_mentions(an.tagged(spark, sf_dir), PANELS, aliases=an.ANALOG_ALIASES,
                              perishable=an.ANALOG_PERISHABLE)


@register("category_mentions")
def q_category_mentions(spark, sf_dir):
    """One row per mention."""
    m = cat.explode_categories(an.tagged(spark, sf_dir))
    return m.select("reviewId", "primary_tag", F.col("pos").cast("long").alias("pos"),
                    "category_raw")


@register("category_normalize")
def q_category_normalize(spark, sf_dir):
    """Mentions with their normalised category."""
    m = cat.explode_categories(an.tagged(spark, sf_dir), keep=("reviewId",))
    n = cat.normalize_categories(m, an.ANALOG_ALIASES)
    return n.select("reviewId", F.col("pos").cast("long").alias("pos"), "category_raw", "category")


def _class_query(mode):
    def q(spark, sf_dir):
        m = cat.explode_categories(an.tagged(spark, sf_dir), keep=("reviewId", "primary_tag"))
        n = cat.normalize_categories(m, an.ANALOG_ALIASES)
        f = cat.filter_class(n, mode, an.ANALOG_PERISHABLE)
        return f.select("reviewId", "primary_tag", F.col("pos").cast("long").alias("pos"),
                        "category")
    q.__doc__ = f"Mentions kept by the {mode} filter (F8, J4)."
    return q


register("cats_perishable")(_class_query("perishable"))
register("cats_nonperishable")(_class_query("nonperishable"))


# --- aggregates over the tagged corpus ----------------------------------------

@register("tag_counts")
def q_tag_counts(spark, sf_dir):
    """Reviews per tag (A1)."""
    return met.tag_counts(an.tagged(spark, sf_dir))


@register("signal_tag_counts")
def q_signal_tag_counts(spark, sf_dir):
    """Reviews per tag without the noise tag (A2)."""
    return met.signal_tag_counts(an.tagged(spark, sf_dir))


@register("tag_by_source")
def q_tag_by_source(spark, sf_dir):
    """Tag x source table, zero-filled (A4)."""
    return met.tag_by_source(an.tagged(spark, sf_dir), an.MARKET_SEGMENTS)


@register("noise_split")
def q_noise_split(spark, sf_dir):
    """Total, noise and signal reviews in one pass."""
    return met.noise_split(an.tagged(spark, sf_dir))


@register("signal_share")
def q_signal_share(spark, sf_dir):
    """Each tag's share of the non-noise reviews."""
    return met.signal_share(an.tagged(spark, sf_dir))


@register("source_share_of_tag")
def q_source_share_of_tag(spark, sf_dir):
    """Per tag, each source's share, next to the source's share of the corpus (A10)."""
    return met.source_share_of_tag(an.tagged(spark, sf_dir))


@register("corpus_size")
def q_corpus_size(spark, sf_dir):
    """Reviews per source."""
    return met.corpus_size(an.tagged(spark, sf_dir))


@register("signal_rows")
def q_signal_rows(spark, sf_dir):
    """Reviews whose tag is not the noise tag; a null tag stays."""
    return flt.signal(an.tagged(spark, sf_dir)).select("reviewId", "primary_tag", "source")


@register("gold_rows")
def q_gold_rows(spark, sf_dir):
    """Reviews that describe trying something new, whole text."""
    return flt.gold_rows(an.tagged(spark, sf_dir), None)


# --- sources over documents and the store feed ---------------------------------

@register("substantive")
def q_substantive(spark, sf_dir):
    """Document reviews with more than 20 characters (F1)."""
    r = flt.substantive(an.reviews(spark, sf_dir))
    return r.select("reviewId", "source")


@register("substantive_yield")
def q_substantive_yield(spark, sf_dir):
    """Rows pulled and substantive rows per app; the document sources play the apps."""
    d = an.table(spark, sf_dir, "documents").select(F.col("source").alias("app"),
                                                    F.col("text").alias("content"))
    return met.substantive_yield(d, "app")


@register("land_play")
def q_land_play(spark, sf_dir):
    """Store export landed as reviews: project, stamp source, text floor."""
    out = land.land_play(an.play_export(spark, sf_dir))
    return out.select("reviewId", "score", F.col("thumbsUpCount").cast("double"), "source",
                      "content")


@register("land_appstore")
def q_land_appstore(spark, sf_dir):
    """App Store export landed as reviews: ios_ ids, rating as score (S3)."""
    out = land.land_appstore(an.appstore_export(spark, sf_dir))
    return out.select("reviewId", "score", F.col("thumbsUpCount").cast("double"), "source",
                      "content")


@register("score_distribution")
def q_score_distribution(spark, sf_dir):
    """Reviews per score of the landed store export (A3)."""
    return met.score_distribution(land.land_play(an.play_export(spark, sf_dir)))


@register("newest_reviews")
def q_newest_reviews(spark, sf_dir):
    """The 60 newest store reviews (the live-fetch default), then the text floor."""
    out = land.newest_reviews(an.play_export(spark, sf_dir), 60)
    return out.select("reviewId", "score", "content")


@register("ingest_column")
def q_ingest_column(spark, sf_dir):
    """Upload path over the whole documents table, ids before the filter."""
    d = an.table(spark, sf_dir, "documents")
    out = land.ingest_text_column(d, "text", order_col="doc_id")
    return out.select("reviewId", "idx", "content")


@register("ingest_lines")
def q_ingest_lines(spark, sf_dir):
    """Paste path: every document is one pasted text, every line a review."""
    d = an.table(spark, sf_dir, "documents")
    out = land.ingest_lines(d, "text", "doc_id")
    return out.select("doc_id", "reviewId", "line_no", "content")


@register("union_sources")
def q_union_sources(spark, sf_dir):
    """Store reviews stacked on document reviews, missing columns null."""
    play = land.land_play(an.play_export(spark, sf_dir)).drop("seq")
    docs = flt.substantive(an.reviews(spark, sf_dir)).drop("seq", "score", "at",
                                                            "thumbsUpCount", "thread")
    u = land.union_sources([play, docs])
    return u.select("reviewId", "score", F.col("thumbsUpCount").cast("double"), "source", "thread",
                    "content")


@register("land_together")
def q_land_together(spark, sf_dir):
    """Store reviews and the documents' sources landed in one table, then the store landed
    again with fewer rows: its own are replaced, the others stay (S11, S10)."""
    path = scratch_path(spark, "landed")
    play = an.play_export(spark, sf_dir)
    files.land_table(land.land_play(play), path, ["play_store"])
    files.land_table(flt.substantive(an.reviews(spark, sf_dir)), path)
    files.land_table(land.land_play(play.where("score >= 3")), path, ["play_store"])
    return files.read_landed(spark, path).select("reviewId", "source", "content", "seq")


@register("file_order")
def q_file_order(spark, sf_dir):
    """Uploaded documents without an order column: ids by place in the files."""
    d = ordr.file_position(an.table(spark, sf_dir, "documents").select("text"))
    out = land.ingest_text_column(d, "text", order_col="position")
    return out.select("reviewId", F.col("idx").cast("long"), "content")


@register("pull_pages")
def q_pull_pages(spark, sf_dir):
    """A store pull in pages of 200 that stops at the page which reaches 3,000 rows, then
    landed (X4, S2)."""
    pulled = land.pull_pages(an.play_export(spark, sf_dir), ("seq",), 200, 3_000)
    return land.land_play(pulled).select("reviewId", "score", "source", "content")


@register("pull_by_page")
def q_pull_by_page(spark, sf_dir):
    """The same target over pages of uneven sizes, each user's reviews a page."""
    export = an.play_export(spark, sf_dir).withColumn("page", F.col("thumbsUpCount"))
    pulled = land.pull_pages(export, target=3_000, page_col="page")
    return pulled.groupBy("page").agg(F.count(F.lit(1)).alias("rows"))


@register("first_n")
def q_first_n(spark, sf_dir):
    """Sample mode: the first 100 reviews in input order."""
    return flt.first_n(an.reviews(spark, sf_dir), 100).select("reviewId", "source")


@register("dedup_content")
def q_dedup_content(spark, sf_dir):
    """Keep the first review of every exact text, in input order."""
    out = ordr.dedup_keep_first(an.reviews(spark, sf_dir), "content", ("seq",))
    return out.select("reviewId", "source", "content")


# --- page dumps and forum threads ----------------------------------------------

def _dumps(spark, sf_dir):
    path = an.write_conversation_dumps(spark, sf_dir, scratch_path(spark, "dumps"))
    return files.read_text_dumps(spark, path)


@register("src_dumps")
def q_src_dumps(spark, sf_dir):
    """Text files read whole, one row per file."""
    return _dumps(spark, sf_dir).select(
        "file", "value")


@register("chunk_text")
def q_chunk_text(spark, sf_dir):
    """Blank-line chunks of every dump, stripped, indexed before filtering."""
    return files.chunk_text(_dumps(spark, sf_dir)).select("file", "idx", "reviewId", "content")


@register("chunk_large")
def q_chunk_large(spark, sf_dir):
    """Chunks of large dumps, each file read by as many tasks as it has splits."""
    path = an.write_large_dumps(spark, sf_dir, scratch_path(spark, "large-dumps"))
    return files.chunk_large_dumps(spark, path).select("file", "idx", "reviewId", "content")


@register("chunk_clean")
def q_chunk_clean(spark, sf_dir):
    """Chunks kept by the length floor and the UI-debris rule."""
    return files.clean_chunks(files.chunk_text(_dumps(spark, sf_dir))).select(
        "file", "idx", "reviewId", "content")


@register("dump_reviews")
def q_dump_reviews(spark, sf_dir):
    """Dumps to reviews: chunk, clean, keep the first copy of each text."""
    return files.land_dumps(_dumps(spark, sf_dir)).select("reviewId", "thread", "idx", "source", "content")


def _threads(spark, sf_dir):
    return thr.parse_threads(an.thread_docs(spark, sf_dir))


@register("thread_posts")
def q_thread_posts(spark, sf_dir):
    """Thread posts: title + '. ' + self text, likes default 0, epoch to time."""
    return thr.thread_posts(_threads(spark, sf_dir)).select(
        "reviewId", "content", "thumbsUpCount", "at", "thread")


@register("thread_comments")
def q_thread_comments(spark, sf_dir):
    """Every comment at every depth of every thread."""
    return thr.thread_comments(_threads(spark, sf_dir)).select(
        "reviewId", "thumbsUpCount", "at", "thread", "depth",
        "content")


@register("thread_report")
def q_thread_report(spark, sf_dir):
    """Per thread: parsed, posts, comments and rows kept, and their running total."""
    return thr.thread_report(_threads(spark, sf_dir))


@register("thread_slug")
def q_thread_slug(spark, sf_dir):
    """Short thread names from URLs."""
    return an.thread_urls(spark, sf_dir).select("thread", thread_slug("thread").alias("slug"))


@register("thread_reviews")
def q_thread_reviews(spark, sf_dir):
    """Thread posts and comments, each text kept once in thread order."""
    return thr.land_threads(_threads(spark, sf_dir)).select(
        "reviewId", "thread", "content")
