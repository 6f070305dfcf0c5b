"""Registered queries of the training-data operators: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.llm import (bpe, fim, fingerprints, html, idfiles, jaccard, mixing, negatives, packing, pii, quality, repeats,
                          vectors)
from feedlens.llm.common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    pages = table(spark, sf_dir, "pages")
    return html.main_text(pages, html.train(pages))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    field = quality.train(docs, table(spark, sf_dir, "labels"))
    doc_id = F.col("doc_id").cast("long")
    return quality.classify(docs.select(doc_id.alias("doc_id"), "text"), field).select(
        "_row.doc_id", quality.held_out(F.col("_row.doc_id")).alias("held_out"), "score", "predicted")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents by the multilingual byte-level vocabulary, and back."""
    import public_tokenizers
    return bpe.encode_decode(table(spark, sf_dir, "documents"),
                             _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents that share 80 % of their 5-word shingles."""
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written as range-coded files in doc_id order and read back."""
    return idfiles.encode_and_read(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with likenesses."""
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of equal label with cosine 0.98 or more, as links and components."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 400-byte strings that occur again anywhere, and what is left
    of their texts."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return repeats.remove_repeats(docs).select(
        "_row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents, and the terms that disclose it."""
    return pii.find(table(spark, sf_dir, "documents"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, against all vectors."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.select("vec_id", "embedding", label.alias("label"))).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix of all sources takes of each document."""
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents rearranged for filling in the middle, and put back."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return fim.restore(fim.fill_in_middle(docs)).select(
        "_row.doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike,
         list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score
  FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id))::INTEGER AS rank,
       n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n
  ON n.anchor_id = p.anchor_id AND NOT n.alike
  AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) <= 5
"""

OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h FROM documents),
u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
         ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM d),
c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS i,
         greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS j,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
s AS (
  SELECT *, coalesce(array_to_string(units[1:i], ''), '') AS prefix,
         coalesce(array_to_string(units[i + 1:j], ''), '') AS middle,
         coalesce(array_to_string(units[j + 1:n], ''), '') AS suffix
  FROM c)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(prefix || middle || suffix) AS restored_sha256
FROM s
"""

QUERIES = {"op1_pack": op1_pack, "op2_html": op2_html, "op3_quality": op3_quality, "op4_bpe": op4_bpe, "op5_jaccard": op5_jaccard, "op6_ids": op6_ids,
           "op7_fingerprint": op7_fingerprint,
           "op8_vectors": op8_vectors, "op9_repeats": op9_repeats,
           "op10_pii": op10_pii, "op11_negatives": op11_negatives, "op12_mixture": op12_mixture, "op13_middle": op13_middle}
ORACLE: dict[str, str] = {"op11_negatives": OP11_SQL, "op13_middle": OP13_SQL}
