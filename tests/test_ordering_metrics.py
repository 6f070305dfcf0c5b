"""Order-dependent operators, category counts, aggregates and validation
(X1-X5, P2, P8, F5-F8, A1-A10, V1-V5, N2, N4, N8, N9)."""

import pytest
from pyspark.sql import functions as F

from feedlens.operators import categories as cat
from feedlens.operators import filters as flt
from feedlens.operators import metrics as met
from feedlens.operators import ordering as ordr
from feedlens.operators import validation as val


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_row_index_dense_and_partition_independent(spark, parts):
    df = spark.range(0, 5000).select((F.col("id") * 7 + 3).alias("k")).repartition(parts)
    rows = ordr.row_index(df, "k", buckets=parts + 3).collect()
    assert sorted(r.idx for r in rows) == list(range(5000))
    assert all(r.idx == (r.k - 3) // 7 for r in rows)


def test_row_index_keeps_null_keys_first(spark):
    df = spark.createDataFrame([(None,), (5,), (1,), (None,), (3,)] * 1, "k long").repartition(3)
    rows = ordr.row_index(df, "k", buckets=3).collect()
    assert sorted(r.idx for r in rows) == [0, 1, 2, 3, 4]
    assert sorted(r.idx for r in rows if r.k is None) == [0, 1]
    assert [r.k for r in sorted(rows, key=lambda r: r.idx)][2:] == [1, 3, 5]


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_dedup_keeps_first_copy_even_for_a_hot_text(spark, parts):
    # one text holds a third of all rows, spread over every partition
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i // 2}") for i in range(3000)]
    df = spark.createDataFrame(rows, "seq long, content string").repartition(parts)
    kept = {r.seq for r in ordr.dedup_keep_first(df, "content", ("seq",)).collect()}
    first = {}
    for s, c in rows:
        first.setdefault(c, s)
    assert kept == set(first.values())


def test_dedup_with_composite_order_and_null_text(spark):
    rows = [("b.txt", 0, "same"), ("a.txt", 5, "same"), ("a.txt", 2, None), ("b.txt", 1, None)]
    df = spark.createDataFrame(rows, "file string, idx long, content string")
    kept = sorted((r.file, r.idx) for r in ordr.dedup_keep_first(df, "content", ("file", "idx")).collect())
    assert kept == [("a.txt", 2), ("a.txt", 5)]


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_sample_exact_is_repeatable(spark, parts):
    df = spark.range(0, 1000).select(F.col("id").cast("string").alias("reviewId")).repartition(parts)
    got = sorted(r.reviewId for r in ordr.sample_exact(df, 50, 42).collect())
    base = sorted(r.reviewId for r in ordr.sample_exact(df.coalesce(1), 50, 42).collect())
    assert got == base and len(got) == 50
    assert ordr.sample_exact(df.limit(10), 50, 42).count() == 10


def tagged(spark):
    rows = [
        ("1", "TRUST_QUALITY", "play_store", ["Curd", "paneer", " milk "], True),
        ("2", "TRUST_QUALITY", "reddit", ["icecream", "ice cream", "Chips"], False),
        ("3", "TRUST_AUTHENTICITY", "reddit", ["electronics", "skincare", "veg"], False),
        ("4", "SERVICE_NOISE", "play_store", [], False),
        ("5", None, "play_store", None, True),
        ("6", "TRUST_QUALITY", None, ["bread", None], False),
    ]
    return spark.createDataFrame(
        rows, "reviewId string, primary_tag string, source string, "
              "categories_mentioned array<string>, explored_new boolean").withColumn(
        "content", F.concat(F.lit("text of review "), F.col("reviewId")))


def test_category_counts_aliases_count_twice(spark):
    c = {r.category: (r.mentions, r.reviews)
         for r in cat.category_counts(tagged(spark), "TRUST_QUALITY").collect()}
    assert c["dairy"] == (2, 1)          # curd + paneer in one review
    assert c["ice cream"] == (2, 1)
    assert c["milk"] == (1, 1) and c["chips"] == (1, 1) and c["bread"] == (1, 1)
    per = {r.category for r in cat.category_counts(tagged(spark), "TRUST_QUALITY", "perishable").collect()}
    assert per == {"dairy", "ice cream", "milk", "bread"}
    non = {r.category for r in cat.category_counts(tagged(spark), "TRUST_AUTHENTICITY",
                                                  "nonperishable").collect()}
    assert non == {"electronics", "skincare"}   # veg -> vegetables is perishable


def test_every_alias_with_case_and_padding(spark):
    from feedlens import codebook as cb
    raws = []
    for raw, canonical in cb.CATEGORY_ALIASES.items():
        raws += [(raw, canonical), (f"  {raw.upper()} ", canonical), (raw.title() + "\t", canonical)]
    raws += [("Milk", "milk"), (" unknown thing ", "unknown thing"), (None, None)]
    df = spark.createDataFrame([(str(i), r) for i, (r, _) in enumerate(raws)],
                               "reviewId string, category_raw string")
    got = {r.reviewId: r.category for r in cat.normalize_categories(df).collect()}
    assert [got[str(i)] for i in range(len(raws))] == [c for _, c in raws]


def test_panels_with_a_hot_category(spark):
    # one category holds a third of all mentions, spread over 16 partitions
    rows = [(str(i), "TRUST_QUALITY", ["milk" if i % 3 == 0 else f"item{i % 50}", "bread"])
            for i in range(3000)]
    t = spark.createDataFrame(rows, "reviewId string, primary_tag string, "
                                    "categories_mentioned array<string>").repartition(16)
    panels = [("all", "TRUST_QUALITY", None), ("fresh", "TRUST_QUALITY", "perishable")]
    got = {(r.panel, r.category): (r.mentions, r.reviews, r.rank)
           for r in cat.category_panels(t, panels, k=3).collect()}
    assert got[("all", "bread")] == (3000, 3000, 1)
    assert got[("all", "milk")] == (1000, 1000, 2)
    assert got[("fresh", "bread")][0] == 3000 and got[("fresh", "milk")][0] == 1000
    assert len([k for k in got if k[0] == "fresh"]) == 2   # only milk and bread are perishable


def test_top_k_ties_by_name_and_shown_mentions(spark):
    counts = spark.createDataFrame([(c, n) for c, n in
                                    [("b", 3), ("a", 3), ("c", 2), ("d", 1), ("e", 1)]],
                                   "category string, mentions long")
    top = cat.top_k(counts, 3).orderBy("rank").collect()
    assert [r.category for r in top] == ["a", "b", "c"]
    s = cat.shown_and_all_mentions(counts, 3).first()
    assert (s.shown_mentions, s.all_mentions) == (8, 10)


def test_raw_counts_keep_spelling(spark):
    raw = {r.category: r.mentions for r in cat.category_counts_raw(tagged(spark), "TRUST_QUALITY").collect()}
    assert raw["icecream"] == 1 and raw["ice cream"] == 1 and raw["Curd"] == 1


def test_tag_aggregates_and_nulls(spark):
    t = tagged(spark)
    assert {r.primary_tag: r.reviews for r in met.tag_counts(t).collect()} == \
        {"TRUST_QUALITY": 3, "TRUST_AUTHENTICITY": 1, "SERVICE_NOISE": 1}
    split = met.noise_split(t).first()
    assert (split.total, split.noise, split.signal) == (6, 1, 5)   # a null tag is signal
    assert flt.signal(t).count() == 5
    x = {r.primary_tag: r.asDict() for r in met.tag_by_source(t, ["play_store", "reddit"]).collect()}
    assert x["TRUST_QUALITY"]["play_store"] == 1 and x["TRUST_QUALITY"]["reddit"] == 1
    assert x["SERVICE_NOISE"]["reddit"] == 0 and None not in x       # crosstab drops nulls
    share = {r.primary_tag: r.share for r in met.signal_share(t).collect()}
    assert share == {"TRUST_QUALITY": 0.75, "TRUST_AUTHENTICITY": 0.25}
    src = {(r.primary_tag, r.source): r for r in met.source_share_of_tag(t).collect()}
    assert src[("TRUST_QUALITY", "reddit")].share_of_tag == 0.5
    gold = {r.reviewId for r in flt.gold_rows(t).collect()}
    assert gold == {"1", "5"}


def test_agreement_null_safe(spark):
    blind = spark.createDataFrame(
        [("a", " price_value "), ("b", "JUNK"), ("c", None), ("d", "junk "), ("e", "INFO_GAP")],
        "reviewId string, your_tag string").withColumn("content", F.lit("some review text"))
    key = spark.createDataFrame(
        [("a", "PRICE_VALUE"), ("b", "PRICE_VALUE"), ("c", "INFO_GAP"), ("d", "X"), ("e", "MENTAL_MODEL")],
        "reviewId string, primary_tag string")
    coded = val.coded(blind, key)
    a = val.agreement(coded).first()
    assert (a.junk_rows, a.agree, a.scored, a.agreement) == (2, 1, 3, 1 / 3)
    dis = sorted(r.reviewId for r in val.disagreements(coded).collect())
    assert dis == ["c", "e"]                       # a null human tag is a disagreement
    conf = {(r.your_tag, r.primary_tag): r.reviews for r in val.confusion(coded).collect()}
    assert conf[(None, "INFO_GAP")] == 1
    empty = val.agreement(val.coded(blind.filter("false"), key)).first()
    assert empty.scored == 0 and empty.agreement is None


def test_blind_copy_and_key(spark):
    t = tagged(spark)
    s = val.validation_sample(t, 3)
    blind, key = val.blind_copy(s), val.answer_key(s)
    assert blind.columns == ["reviewId", "content", "your_tag"]
    assert {r.your_tag for r in blind.collect()} == {""}
    assert sorted(r.reviewId for r in key.collect()) == sorted(r.reviewId for r in blind.collect())
