"""From raw documents to packed training sequences, stage by stage.

Each stage takes the documents that the stage before kept, written as Parquet and read
again, and returns them with the columns of ``documents`` (``n_chars`` follows the text);
the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.llm import jaccard, packing, pii, quality, repeats
from feedlens.llm.common import materialise, table

ORACLE_SQL = None  # none of the five stages can be put in SQL; tests compare with brute force


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns asked for, n_chars following the text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    field = quality.train(docs, table(spark, sf_dir, "labels"))
    found = quality.classify(docs, field).where("predicted = 1")
    return found.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id. Of
    rows that repeat a doc_id and its text one stays, rows that repeat a doc_id with
    another text are documents of their own; rows without a doc_id all stay."""
    twice = materialise(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
                        .select(F.col("doc_id").alias("_twice")), "ids-twice")
    if not twice.isEmpty():
        return _drop_by_row(docs, twice)
    found = jaccard.similar_documents(docs)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    if gone.count() <= jaccard.MAX_BROADCAST_IDS:
        gone = F.broadcast(gone)
    return _spread(_held(docs).join(gone, F.col("_row.doc_id") == F.col("_gone"), "left_anti"), docs.columns)


def _held(docs: DataFrame) -> DataFrame:
    """All columns in one struct, so that no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def _spread(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns])


def _drop_by_row(docs: DataFrame, twice: DataFrame) -> DataFrame:
    """``drop_near_copies`` where the ids in ``twice`` repeat: rows are numbered and compared."""
    doc_id, text = F.col("_row.doc_id"), F.col("_row.text")
    rows = materialise(_held(docs).withColumn("_no", F.when(doc_id.isNotNull(), F.monotonically_increasing_id())), "rows")
    found = jaccard.similar_documents(rows.select(F.col("_no").alias("doc_id"), text.alias("text"))) \
        .where("doc_id is not null").select(F.col("doc_id").alias("_at"), "component_id")
    stay = found.join(rows.select("_no", doc_id.alias("_id")), F.col("_at") == F.col("_no")).groupBy("component_id") \
        .agg(F.min(F.struct("_id", "_no")).alias("first")).select(F.col("first._no").alias("_stay"))
    kept = rows.join(stay, F.col("_no") == F.col("_stay"), "left_semi")
    # Texts without shingles are near to nothing, their own copies included.
    alike = kept.join(twice, doc_id == F.col("_twice"), "left_semi") \
        .withColumn("_id", doc_id).withColumn("_text", text).dropDuplicates(["_id", "_text"]).drop("_id", "_text")
    return _spread(kept.join(twice, doc_id == F.col("_twice"), "left_anti").unionByName(alike)
                   .unionByName(rows.where(doc_id.isNull())), docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 400-byte strings that occur more than once."""
    found = repeats.remove_repeats(docs)
    others = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != "text"]
    return _counted(found.select(*others, "text"), docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data, and terms that disclose it, generalised to their kinds."""
    return _counted(pii.sanitise(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, in sequences of at most 4096 tokens."""
    import public_tokenizers
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_copies", drop_near_copies),
    ("repeats", drop_repeats),
    ("personal_data", hide_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
