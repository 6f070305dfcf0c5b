"""Landing jobs, CSV import, list literals and page dumps."""

import datetime as dt
import os

from pyspark.sql import functions as F

from feedlens import schemas
from feedlens.functions.lists import parse_list
from feedlens.sources import files, landing

T20 = "a" * 20
T21 = "b" * 21


def test_land_play_filters_and_projects(spark):
    rows = [("r1", T20, 5, 1, dt.datetime(2024, 1, 1)), ("r2", T21, 4, None, None),
            ("r3", None, 3, 0, None), ("r4", "ok " * 10, None, 2, None)]
    df = spark.createDataFrame(rows, schemas.PLAY_EXPORT)
    out = landing.land_play(df).orderBy("reviewId").collect()
    assert [r.reviewId for r in out] == ["r2", "r4"]
    assert out[0].source == "play_store" and out[0].thread is None
    assert out[0].score == 4.0 and out[1].score is None


def test_land_appstore_cap_then_filter(spark):
    rows = [(str(i), T20 if i % 2 else T21, 5, None) for i in range(10)]
    df = spark.createDataFrame(rows, schemas.APPSTORE_EXPORT).withColumn("seq", F.col("id").cast("long"))
    out = landing.land_appstore(df, limit=4).orderBy("seq").collect()
    # first 4 rows by feed order, then the length filter: ids 0 and 2 survive
    assert [r.reviewId for r in out] == ["ios_0", "ios_2"]
    assert all(r.thumbsUpCount is None and r.source == "app_store" for r in out)


def test_ingest_text_column_ids_before_filter(spark):
    vals = [T21, "short", None, T21 + "x", T20, T21 + "yy"]
    df = spark.createDataFrame([(i * 10, v) for i, v in enumerate(vals)], "k long, t string")
    out = landing.ingest_text_column(df, "t", order_col="k").orderBy("idx").collect()
    assert [r.reviewId for r in out] == ["up_0", "up_3", "up_5"]
    capped = landing.ingest_text_column(df, "t", order_col="k", cap=2).collect()
    assert sorted(r.reviewId for r in capped) == ["up_0", "up_3"]


def test_ingest_text_column_null_reads_as_nan(spark):
    df = spark.createDataFrame([(1, None), (2, 12345.0)], "k long, t double")
    out = landing.ingest_text_column(df, "t", order_col="k").collect()
    assert out == []  # 'nan' and '12345.0' are both too short


def test_ingest_lines_ids_after_filter(spark):
    text = "\n".join([" " + T21 + " ", "tiny", "", T20, "   " + T21 + "z", " "])
    df = spark.createDataFrame([(1, text)], "k long, t string")
    out = landing.ingest_lines(df, "t", "k").orderBy("line_no").collect()
    assert [(r.reviewId, r.content) for r in out] == [("own_0", T21), ("own_1", T21 + "z")]
    assert len(landing.ingest_lines(df, "t", "k", cap=1).collect()) == 1


def test_newest_reviews_limit_then_filter(spark):
    rows = [(f"r{i}", T21 if i != 9 else "short", 5, 0, dt.datetime(2024, 1, 1, 0, i))
            for i in range(10)]
    df = spark.createDataFrame(rows, schemas.PLAY_EXPORT)
    out = landing.newest_reviews(df, 3).collect()
    assert sorted(r.reviewId for r in out) == ["r7", "r8"]  # r9 is newest but too short


def test_union_sources_fills_missing_columns(spark):
    a = spark.createDataFrame([("1", T21, 5.0)], "reviewId string, content string, score double")
    b = spark.createDataFrame([("2", T21, "t")], "reviewId string, content string, thread string")
    out = landing.union_sources([a, b]).orderBy("reviewId").collect()
    assert out[0].thread is None and out[1].score is None


def test_written_table_prunes_by_source(spark, tmp_dir):
    df = spark.createDataFrame([("1", "reddit", T21), ("2", "play_store", T21)],
                               "reviewId string, source string, content string")
    path = os.path.join(tmp_dir, "t")
    files.write_table(df, path)
    q = spark.read.parquet(path).filter(F.col("source") == "reddit")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in plan
    assert [r.reviewId for r in q.collect()] == ["1"]


def test_empty_csv_gives_zero_rows(spark, tmp_dir):
    p = os.path.join(tmp_dir, "empty.csv")
    with open(p, "w") as f:
        f.write("\n")
    assert files.read_reviews_csv(spark, p, schemas.TAGGED_CSV).count() == 0


def test_csv_roundtrip_multiline_tokens_and_literals(spark, tmp_dir):
    p = os.path.join(tmp_dir, "tagged.csv")
    header = ("reviewId,content,score,thumbsUpCount,at,source,thread,id,primary_tag,"
              "secondary_tag,categories_mentioned,explored_new,sentiment\n")
    body = (
        'u1,"line one\nline ""two""",1.0,0.0,2024-07-01 10:00:00,play_store,,u1,TRUST_QUALITY,'
        ",\"['dairy', 'milk']\",False,negative\n"
        "u2,plain text that is long,NA,,,play_store,None,u2,SERVICE_NOISE,null,[],True,positive\n"
        "u3,x,5.0,3.0,,reddit,t,u3,PRICE_VALUE,INFO_GAP,\"('a', 'b',)\",False,mixed\n"
    )
    with open(p, "w") as f:
        f.write(header + body)
    rows = {r.reviewId: r for r in files.read_reviews_csv(spark, p).collect()}
    assert rows["u1"].content == 'line one\nline "two"'
    assert rows["u1"].thumbsUpCount == 0 and rows["u1"].categories_mentioned == ["dairy", "milk"]
    assert rows["u1"].explored_new is False and rows["u2"].explored_new is True
    assert rows["u2"].score is None and rows["u2"].thread is None
    assert rows["u2"].secondary_tag is None and rows["u2"].categories_mentioned == []
    assert rows["u3"].categories_mentioned == ["a", "b"]
    assert rows["u1"].at == dt.datetime(2024, 7, 1, 10, 0)


def test_import_csv_once_to_parquet(spark, tmp_dir):
    p = os.path.join(tmp_dir, "in.csv")
    with open(p, "w") as f:
        f.write("reviewId,content,score,thumbsUpCount,at,source,thread\n"
                'a,"two\nlines of review text here",5.0,1.0,2024-01-01 00:00:00,play_store,\n')
    out = files.import_reviews_csv(spark, p, os.path.join(tmp_dir, "pq"), schemas.REVIEWS_CSV)
    r = out.collect()
    assert len(r) == 1 and r[0].content == "two\nlines of review text here"
    assert "Parquet" in out._jdf.queryExecution().executedPlan().toString()


def test_reviews_csv_epoch_and_float_likes(spark, tmp_dir):
    p = os.path.join(tmp_dir, "reddit.csv")
    with open(p, "w") as f:
        f.write("reviewId,content,score,thumbsUpCount,at,source,thread\n"
                "abc,a comment that is long enough,,12.0,1700000000.0,reddit,https://x/comments/1/\n"
                "def,a store review that is long,4.0,0.0,2024-07-01 10:00:00,play_store,\n")
    rows = {r.reviewId: r for r in files.read_reviews_csv(spark, p, schemas.REVIEWS_CSV).collect()}
    assert rows["abc"].at == dt.datetime(2023, 11, 14, 22, 13, 20)
    assert rows["abc"].thumbsUpCount == 12 and rows["abc"].score is None
    assert rows["def"].at == dt.datetime(2024, 7, 1, 10, 0) and rows["def"].thread is None


def test_parse_list_literal_cases(spark):
    values = ["['a', 'b']", "[\"baby's food\"]", "[]", "['a',]", "('a', 'b')", "['x', None]",
              "None", "5", "oops", None, "'abc'", '["ice cream", "Veg "]', "{'k': 1}",
              "{'b', 'a'}", "[1, 2.5]"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    got = [r.l for r in df.select(parse_list("s").alias("l")).orderBy(F.lit(1)).collect()]
    got = [r.l for r in df.orderBy("i").select(parse_list("s").alias("l")).collect()]
    assert got == [["a", "b"], ["baby's food"], [], ["a"], ["a", "b"], ["x", "None"],
                   None, None, None, None, ["a", "b", "c"], ["ice cream", "Veg "], ["k"],
                   ["a", "b"], ["1", "2.5"]]


def _write_dumps(d):
    os.makedirs(d, exist_ok=True)
    chunk24, chunk25 = "c" * 24, "d" * 25
    chunk59 = "reply " + "e" * 53   # debris: UI word and < 60
    chunk60 = "reply " + "f" * 54   # 60 chars: kept
    t1 = f"Intro paragraph that is long enough\n\n \n\n{chunk24}\n\n{chunk25}\n\n{chunk59}\n\n{chunk60}"
    t10 = "Common comment seen twice in two files\n\nUpvote\n\n2h ago\n\nA person in Chicago wrote"
    t2 = "Common comment seen twice in two files\n\nAnother long enough chunk of human text"
    for name, text in [("thread1.txt", t1), ("thread10.txt", t10), ("thread2.txt", t2),
                       ("notes.md", "ignored file with long enough text")]:
        with open(os.path.join(d, name), "w", encoding="utf-8") as f:
            f.write(text)
    return chunk25, chunk60


def test_dumps_chunk_clean_dedup(spark, tmp_dir):
    chunk25, chunk60 = _write_dumps(tmp_dir)
    dumps = files.read_text_dumps(spark, tmp_dir)
    assert sorted(r.file for r in dumps.collect()) == ["thread1.txt", "thread10.txt", "thread2.txt"]
    chunks = files.chunk_text(dumps)
    c1 = {r.idx: r.content for r in chunks.filter("file = 'thread1.txt'").collect()}
    assert c1[1] == "" and c1[2] == "c" * 24  # ' ' line is a chunk, stripped to ''
    kept = {r.reviewId for r in files.clean_chunks(chunks).collect()}
    assert "thread1.txt_2" not in kept and "thread1.txt_3" in kept      # 24 out, 25 in
    assert "thread1.txt_4" not in kept and "thread1.txt_5" in kept      # debris < 60 only
    assert "thread10.txt_3" not in kept  # 'Chicago' holds 'ago' and is short
    land = {r.reviewId: r for r in files.land_dumps(dumps).collect()}
    # the shared chunk is kept once, from the first file in name order (thread1 < thread10 < thread2)
    assert "thread10.txt_0" in land and "thread2.txt_0" not in land
    assert land["thread1.txt_5"].content == chunk60 and land["thread1.txt_5"].source == "reddit_manual"


def test_dumps_are_listed_by_few_tasks(spark, tmp_dir):
    """A folder per dump is no listing task of its own, and the setting is put back."""
    folder, key = os.path.join(tmp_dir, "d"), "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    for k in range(60):
        os.makedirs(f"{folder}/thread=t{k}.txt")
        with open(f"{folder}/thread=t{k}.txt/part-0.txt", "w") as f:
            f.write(f"text {k}")
    before = spark.conf.get(key)
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        dumps = files.read_text_dumps(spark, folder)
        tracker = spark.sparkContext.statusTracker()
        stages = [s for j in tracker.getJobIdsForGroup(None) + tracker.getJobIdsForGroup("listing")
                  for s in tracker.getJobInfo(j).stageIds]
        info = [i for i in map(tracker.getStageInfo, stages) if i is not None and "text" in i.name]
        assert info and info[-1].numTasks <= 4 * spark.sparkContext.defaultParallelism < 60
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert spark.conf.get(key) == before
    assert sorted(r.value for r in dumps.collect()) == sorted(f"text {k}" for k in range(60))
