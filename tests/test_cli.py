"""The command-line jobs end to end on invented rows."""

import datetime as dt
import os

from feedlens import cli, schemas
from test_sources import _write_dumps
from test_threads import LONG, node, thread_doc


def test_land_dumps_and_threads(spark, tmp_dir):
    dumps_dir, out = os.path.join(tmp_dir, "dumps"), os.path.join(tmp_dir, "pasted")
    _write_dumps(dumps_dir)
    cli.main(["land-dumps", "--input", dumps_dir, "--output", out], spark=spark)
    pasted = spark.read.parquet(out)
    assert pasted.count() > 0 and {r.source for r in pasted.collect()} == {"reddit_manual"}
    threads_in, forum = os.path.join(tmp_dir, "threads"), os.path.join(tmp_dir, "forum")
    spark.createDataFrame([("https://f/comments/a/1/", thread_doc("A post title here", "body",
                                                                   [node("c1", LONG)]))],
                          "thread string, json string").write.parquet(threads_in)
    cli.main(["land-threads", "--input", threads_in, "--output", forum], spark=spark)
    assert sorted(r.reviewId for r in spark.read.parquet(forum).collect()) == ["c1", "p_A p"]


def test_land_tag_sample_agreement(spark, tmp_dir, capsys):
    export = os.path.join(tmp_dir, "export")
    rows = [(f"r{i}", ("the milk was rotten again, never fresh" if i % 3 == 0 else
                      "great app, fast delivery and good service"), 1 + i % 5, i,
             dt.datetime(2024, 1, 1, 0, i)) for i in range(40)]
    rows.append(("short", "too short", 5, 0, dt.datetime(2024, 1, 2)))
    spark.createDataFrame(rows, schemas.PLAY_EXPORT).write.parquet(export)
    landed, tagged = os.path.join(tmp_dir, "landed"), os.path.join(tmp_dir, "tagged")
    blind, key = os.path.join(tmp_dir, "blind.csv"), os.path.join(tmp_dir, "key.csv")

    cli.main(["land-play", "--input", export, "--output", landed], spark=spark)
    assert spark.read.parquet(landed).count() == 40
    cli.main(["tag", "--input", landed, "--output", tagged], spark=spark)
    t = spark.read.parquet(tagged)
    assert t.count() == 40
    assert t.filter("primary_tag = 'TRUST_QUALITY'").count() == 14
    cli.main(["sample", "--input", tagged, "--blind", blind, "--key", key, "--n", "10"],
             spark=spark)
    assert spark.read.option("header", True).csv(blind).count() == 10
    cli.main(["agreement", "--blind", blind, "--key", key], spark=spark)
    out = capsys.readouterr().out
    assert "junk_rows" in out and "agreement" in out
    cli.main(["panels", "--input", tagged], spark=spark)
    assert "freshness" in capsys.readouterr().out
    cli.main(["report", "--input", tagged, "--tag", "TRUST_QUALITY"], spark=spark)
    out = capsys.readouterr().out
    assert "milk" in out and "gold rows:" in out


class OneTag:
    """A tagger of the user's own, named on the command line."""

    def __call__(self, rows):
        return [{"id": r["id"], "primary_tag": "INFO_GAP", "sentiment": "mixed"} for r in rows]


def test_own_tagger_upload_paste_newest_and_scores(spark, tmp_dir, capsys):
    def at(name):
        return os.path.join(tmp_dir, name)

    rows = [(f"r{i}", f"a review text that is long enough {i}", 1 + i % 5, i, dt.datetime(2024, 1, 1, 0, i))
            for i in range(30)]
    spark.createDataFrame(rows, schemas.PLAY_EXPORT).coalesce(1).write.parquet(at("export"))
    cli.main(["newest", "--input", at("export"), "--n", "7", "--output", at("newest")], spark=spark)
    assert sorted(r.reviewId for r in spark.read.parquet(at("newest")).collect()) == [f"r{i}" for i in range(23, 30)]
    cli.main(["land-play", "--input", at("export"), "--output", at("play")], spark=spark)
    cli.main(["tag", "--input", at("newest"), "--input", at("play"), "--output", at("tagged"), "--tagger",
              "test_cli:OneTag", "--first", "20", "--run-id", "x"], spark=spark)
    tagged = spark.read.parquet(at("tagged"))
    assert {r.primary_tag for r in tagged.collect()} == {"INFO_GAP"}
    assert spark.read.parquet(at("tagged_batches")).agg({"n_rows": "sum"}).first()[0] == 20
    assert spark.read.parquet(at("tagged_replies")).count() == 2
    cli.main(["scores", "--input", at("play")], spark=spark)
    assert "5.0\t6" in capsys.readouterr().out
    cli.main(["report", "--input", at("tagged"), "--tag", "INFO_GAP", "--output", at("report")], spark=spark)
    assert spark.read.parquet(at("report/tag_by_source")).count() == 1

    spark.createDataFrame([(3, "third text, long enough to keep"), (1, "short"), (2, "second text, long enough to keep\nand more of it, long enough too")],
                          "k long, words string").write.parquet(at("table"))
    cli.main(["upload", "--input", at("table"), "--column", "words", "--order", "k", "--output", at("up")], spark=spark)
    assert sorted(r.reviewId for r in spark.read.parquet(at("up")).collect()) == ["up_1", "up_2"]
    cli.main(["paste", "--input", at("table"), "--column", "words", "--order", "k", "--output", at("own")], spark=spark)
    assert sorted((r.k, r.reviewId) for r in spark.read.parquet(at("own")).collect()) == [(2, "own_0"), (2, "own_1"), (3, "own_0")]
