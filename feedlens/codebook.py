"""The fixed vocabulary of the classifier, held as small dimension tables.

Everything here is configuration data. The first block holds values that must
equal the reference's for results to match; they are stated plainly, in the
order the reference states them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's).
# ---------------------------------------------------------------------------
PRIMARY_TAGS = [
    "HABIT_AUTOPILOT",
    "MENTAL_MODEL",
    "TRUST_QUALITY",
    "TRUST_AUTHENTICITY",
    "PRICE_VALUE",
    "DISCOVERY_GAP",
    "INFO_GAP",
    "SERVICE_NOISE",
]
NOISE_TAG = "SERVICE_NOISE"
HUMAN_ONLY_TAG = "JUNK"
SENTIMENTS = ["positive", "negative", "mixed"]

CATEGORY_ALIASES = {
    "icecream": "ice cream",
    "ice-cream": "ice cream",
    "veggies": "vegetables",
    "veg": "vegetables",
    "vegetable": "vegetables",
    "fruit": "fruits",
    "curd": "dairy",
    "paneer": "dairy",
}
PERISHABLE = [
    "vegetables", "fruits", "milk", "ice cream", "dairy",
    "chicken", "eggs", "meat", "bread",
]

# Categories that the tagging instructions name as examples.
EXAMPLE_CATEGORIES = [
    "fruits", "vegetables", "milk", "snacks", "skincare",
    "electronics", "pet", "baby", "household", "medicines",
]

# Page-dump cleaning: chunk length floor, debris length ceiling and the UI words
# that mark a short chunk as debris (plain substring match on lower case).
MIN_CHUNK_CHARS = 25
DEBRIS_MAX_CHARS = 60
UI_DEBRIS_WORDS = [
    "reply", "share", "report", "upvote", "downvote",
    "· ", "ago", "points", "sort by", "view more",
]

# Store-text floor (strict: length > 20), batch size, failure budget, previews.
MIN_CONTENT_CHARS = 20
BATCH_SIZE = 15
FAILURE_BUDGET = 3
PROMPT_PREVIEW_CHARS = 600
GOLD_PREVIEW_CHARS = 200
DISAGREEMENT_PREVIEW_CHARS = 120
TOP_K_CATEGORIES = 8
SAMPLE_SIZE = 50
SAMPLE_SEED = 42
# ---------------------------------------------------------------------------


def codebook_df(spark: SparkSession, tags: list[str] | None = None,
                noise: str = NOISE_TAG) -> DataFrame:
    """codebook(tag string, is_noise boolean)."""
    tags = tags or PRIMARY_TAGS
    return spark.createDataFrame([(t, t == noise) for t in tags],
                                 "tag string, is_noise boolean")


def alias_df(spark: SparkSession, aliases: dict[str, str] | None = None) -> DataFrame:
    """category_alias(raw string, canonical string)."""
    aliases = CATEGORY_ALIASES if aliases is None else aliases
    schema = T.StructType([T.StructField("raw", T.StringType(), False),
                           T.StructField("canonical", T.StringType(), False)])
    return spark.createDataFrame(sorted(aliases.items()), schema)


def category_class_df(spark: SparkSession, perishable: list[str] | None = None) -> DataFrame:
    """category_class(category string, perishable boolean): the perishable set."""
    perishable = PERISHABLE if perishable is None else perishable
    schema = T.StructType([T.StructField("category", T.StringType(), False),
                           T.StructField("perishable", T.BooleanType(), False)])
    return spark.createDataFrame([(c, True) for c in perishable], schema)


def sentiment_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in SENTIMENTS], "sentiment string")
