"""Explicit schemas for every relation (the reference infers them on each read)."""

from __future__ import annotations

from pyspark.sql import types as T

# One row per review, post, comment or text chunk. Times are wall-clock
# (TIMESTAMP_NTZ), so results never depend on the session time zone.
REVIEWS = T.StructType([
    T.StructField("reviewId", T.StringType(), False),
    T.StructField("content", T.StringType(), True),
    T.StructField("score", T.DoubleType(), True),
    T.StructField("thumbsUpCount", T.LongType(), True),
    T.StructField("at", T.TimestampNTZType(), True),
    T.StructField("source", T.StringType(), True),
    T.StructField("thread", T.StringType(), True),
])

# R1 as landed: with its place in its source's input, where that is known.
LANDED = T.StructType([*[T.StructField(f.name, f.dataType) for f in REVIEWS.fields], T.StructField("seq", T.LongType())])

# R2: one element of the classifier's reply array. The short reply variant
# has no secondary_tag / explored_new; from_json reads those as null.
TAG = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("primary_tag", T.StringType(), True),
    T.StructField("secondary_tag", T.StringType(), True),
    T.StructField("categories_mentioned", T.ArrayType(T.StringType()), True),
    T.StructField("explored_new", T.BooleanType(), True),
    T.StructField("sentiment", T.StringType(), True),
])
TAG_REPLY = T.ArrayType(TAG)

# Reviews joined to tags (13 columns, in the reference's CSV order).
TAGGED = T.StructType(list(REVIEWS.fields) + list(TAG.fields))

# R1 as stored in CSV exports: the like count was written as a float, and `at`
# holds either a date-time or epoch seconds (forum rows).
REVIEWS_CSV = T.StructType([
    T.StructField("reviewId", T.StringType(), True),
    T.StructField("content", T.StringType(), True),
    T.StructField("score", T.DoubleType(), True),
    T.StructField("thumbsUpCount", T.DoubleType(), True),
    T.StructField("at", T.StringType(), True),
    T.StructField("source", T.StringType(), True),
    T.StructField("thread", T.StringType(), True),
])

# R3 as stored in CSV exports: the category list is a Python-literal string and
# thumbsUpCount was written as a float.
TAGGED_CSV = T.StructType([
    T.StructField("reviewId", T.StringType(), True),
    T.StructField("content", T.StringType(), True),
    T.StructField("score", T.DoubleType(), True),
    T.StructField("thumbsUpCount", T.DoubleType(), True),
    T.StructField("at", T.StringType(), True),
    T.StructField("source", T.StringType(), True),
    T.StructField("thread", T.StringType(), True),
    T.StructField("id", T.StringType(), True),
    T.StructField("primary_tag", T.StringType(), True),
    T.StructField("secondary_tag", T.StringType(), True),
    T.StructField("categories_mentioned", T.StringType(), True),
    T.StructField("explored_new", T.StringType(), True),
    T.StructField("sentiment", T.StringType(), True),
])

# Blind copy and answer key of the validation sample.
BLIND = T.StructType([
    T.StructField("reviewId", T.StringType(), False),
    T.StructField("content", T.StringType(), True),
    T.StructField("your_tag", T.StringType(), True),
])
KEY = T.StructType([
    T.StructField("reviewId", T.StringType(), False),
    T.StructField("primary_tag", T.StringType(), True),
])

# F-E: store exports as landed files.
PLAY_EXPORT = T.StructType([
    T.StructField("reviewId", T.StringType(), True),
    T.StructField("content", T.StringType(), True),
    T.StructField("score", T.IntegerType(), True),
    T.StructField("thumbsUpCount", T.LongType(), True),
    T.StructField("at", T.TimestampNTZType(), True),
])
APPSTORE_EXPORT = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("content", T.StringType(), True),
    T.StructField("rating", T.IntegerType(), True),
    T.StructField("date", T.TimestampNTZType(), True),
])

# One thread document per row (raw JSON text; parsed to VARIANT).
THREAD_JSON = T.StructType([
    T.StructField("thread", T.StringType(), False),
    T.StructField("json", T.StringType(), True),
])

# One row per classifier batch.
BATCH_RESULT = T.StructType([
    T.StructField("batch_id", T.LongType(), False),
    T.StructField("n_rows", T.LongType(), False),
    T.StructField("reply", T.StringType(), True),
    T.StructField("error", T.StringType(), True),
])

# A stored reply also names what was asked: the batch's ids and texts, and the tagger.
STORED_REPLY = T.StructType([*BATCH_RESULT.fields, T.StructField("batch_hash", T.StringType(), True)])
