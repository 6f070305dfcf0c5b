"""Scalar text helpers against Python semantics."""

from pyspark.sql import functions as F

from feedlens.functions.text import (is_ui_debris, normalize_category_key, normalize_label,
                                     preview, strip_fence, substantive, thread_slug, trim_u)


def _col(spark, values, expr):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return [r[0] for r in df.select(expr(F.col("s"))).collect()]


def test_trim_u_matches_python_strip(spark):
    values = ["  a  ", " b　", "\x1cc\x1f", "\n\td\r\n", " ", "", "e ", None,
              "​f"]  # zero-width space is not whitespace in Python
    got = _col(spark, values, trim_u)
    assert got == [None if v is None else v.strip() for v in values]


def test_length_counts_code_points_and_is_strict(spark):
    values = ["x" * 20, "x" * 21, "👍" * 21, "👍👍é", None]
    got = _col(spark, values, lambda c: substantive(c, 20))
    assert got == [False, True, True, False, False]


def test_preview_by_code_point(spark):
    assert _col(spark, ["👍abc", "ab"], lambda c: preview(c, 2)) == ["👍a", "ab"]


def test_normalize_label(spark):
    assert _col(spark, [" junk ", "service_noise", None, " Trust_Quality"],
                normalize_label) == ["JUNK", "SERVICE_NOISE", None, "TRUST_QUALITY"]


def test_category_key(spark):
    assert _col(spark, ["  Ice Cream ", "VEG", None], normalize_category_key) == \
        ["ice cream", "veg", None]


def test_strip_fence_variants(spark):
    values = [
        '[{"id": "1"}]',
        '```json\n[{"id": "1"}]\n```',
        '```\n[{"id": "1"}]\n```',
        '  ```JSON\n[]\n```  ',
        '[{"id": "1", "note": "json"}]',
        "```json\n[",
        None,
    ]
    got = _col(spark, values, strip_fence)
    assert got[0] == '[{"id": "1"}]'
    assert got[1] == '[{"id": "1"}]'
    assert got[2] == '[{"id": "1"}]'
    assert got[3] == "JSON\n[]"  # tag match is case sensitive, as in the reference
    assert got[4] == values[4]   # "json" inside the payload is left alone
    assert got[5] == "["
    assert got[6] is None


def test_thread_slug(spark):
    url = "https://www.example.com/r/x/comments/abc123/" + "a" * 60 + "/"
    got = _col(spark, [url, "https://example.com/no/slug", None], thread_slug)
    assert got[0] == url.split("/comments/")[1][:45]
    assert got[1] is None and got[2] is None


def test_ui_debris_is_plain_substring_and_short_only(spark):
    values = ["Reply Share Report", "I live in Chicago now ok",  # 'ago' inside Chicago
              "Chicago " + "x" * 60, "plain human text here ok", "3 points · 2h"]
    got = _col(spark, values, is_ui_debris)
    assert got == [True, True, False, False, True]
