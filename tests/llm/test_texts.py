"""Extraction, quality, personal data and the pipeline."""

import hashlib
import itertools
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import brute
import corpus_pipeline
from feedlens.llm import html, pii, quality

SF = "/root/testdata/sf0.01"


def page(k, body):
    return (f"<html><head><title>t{k}</title><style>p{{}}</style></head><body><nav><ul><li><a href=/a>Home {k}</a></li>"
            f"<li>About</ul></nav><header><p>Site header</header><article><h1>Title {k}</h1>{body}</article><aside><p>Related"
            f"</aside><form>Name <input></form><div class='comments'><p>A reader says {k}</div><footer>&copy; {k}</footer></body></html>")


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"u{k}", page(k, "".join(f"<p>Sentence {j} of page {k}, it is &lt;long&gt; enough.\n  Yes.</p>"
                                            for j in range(1 + k % 6)))) for k in range(120)]
    rows += [(500, None, None), (501, "u", ""), (502, "u", "<script>if (a < b) {}</script>"), (None, None, rows[3][2]), (3, "u3", rows[3][2])]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "9 AS n_chars")


def test_main_text(pages):
    rows = html.main_text(pages, html.train(pages)).collect()
    assert len(rows) == 125
    for r in rows:
        if r.page_id is None or r.page_id < 500:
            k = 3 if r.page_id is None else r.page_id
            want = [f"Title {k}"] + [f"Sentence {j} of page {k}, it is <long> enough. Yes." for j in range(1 + k % 6)]
            assert r.text == "\n".join(want) and r.n_chars == len(r.text)
        else:
            assert (r.text, r.n_chars) == ("", 0)


def test_empty_pages(pages):
    assert html.main_text(pages.limit(0), html.train(pages.limit(0))).count() == 0


def test_blocks():
    texts = [b.text for b in html.blocks_of("<head><title>a</title><body>x &amp; y<br>z<p>w<p><b>v</b>u<ul><li>1<li>2</ul>"
                                            "<noscript>n</noscript><!-- c --><table><tr><td>3<td>4</table>&#x41;&nbsp;b")]
    assert texts == ["x & y z", "w", "vu", "1", "2", "n", "3", "4", "A b"]


def test_malformed_pages_do_not_end_the_job(pages):
    def read(markup):
        return [b.text for b in html.blocks_of(markup)]

    assert read("<p>a<![foo]>b") == ["ab"] and read("a<![CDATA[q > r]]>b<!x>c<?php d?>e</ f>g") == ["a r]]>bceg"]
    assert read("<p>see <math><mi>x</mi></math> and <noscript>no script</noscript> end") == ["see x and", "no script", "end"]
    assert read("<p>x<iframe src=a>y<object>z<p>w") == ["xyz", "w"] and read("<![ x <p>y")[-1].endswith("y")
    rnd = random.Random(1)
    parts = ["<", "!", "[", "]", ">", "--", "<!", "<![", "CDATA", "a", "/", "<p>", "</p>", '"', "=", "&", "&#x", "&#99999999999;",
             "<script>", "</script>", "<title>", "<svg>", "\0", "<a href=", "?", "<?", " "]
    for _ in range(5_000):
        read("".join(rnd.choice(parts) for _ in range(rnd.randrange(14))))


def test_long_pages_are_learnt_and_kept(spark):
    """All pages above the length of a piece; one of 10,000 blocks."""
    def long(k, n):
        return page(k, "".join(f"<p>Sentence {j} of page {k}, see <math><mi>x</mi></math> and more.</p>" for j in range(n)))

    df = spark.createDataFrame([(k, f"u{k}", long(k, 60)) for k in range(40)] + [(99, "u", long(99, 10_000))],
                               "page_id long, url string, html string").repartition(3)
    net = html.train(df, longest=50, chars=20_000)
    for r in html.main_text(df, net).collect():
        n = 10_000 if r.page_id == 99 else 60
        assert r.text.split("\n") == [f"Title {r.page_id}"] + [f"Sentence {j} of page {r.page_id}, see x and more." for j in range(n)]


def test_gradients_are_those_of_the_loss(pages):
    blocks = [html.blocks_of(page(k, "<p>one two<p>three" * (k + 1))) for k in range(3)]
    x, mask = html._padded([html.features(b) for b in blocks])
    y, _ = html._padded([html.by_rule(b) for b in blocks])
    net = html.Labeller()
    loss, grad = net.gradients(x, mask, y)
    for name, g in grad.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        net.p[name][at] += 1e-6
        assert (net.gradients(x, mask, y)[0] - loss) / 1e-6 == pytest.approx(g[at], rel=1e-3, abs=1e-7)
        net.p[name][at] -= 1e-6


def test_forward_backward_against_all_labelings():
    rng = np.random.default_rng(0)
    z, step, off = rng.normal(size=6), rng.normal(size=(2, 2)), np.array([0, 4, 4, 6])
    got, expected = quality.marginals(z, off, step)
    count = np.zeros((2, 2))
    for a, b in zip(off, off[1:]):
        total, good, pairs = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for code in range(2 ** (b - a)):
            y = [code >> k & 1 for k in range(b - a)]
            w = np.exp(sum(z[a + k] * v for k, v in enumerate(y)) + sum(step[u, v] for u, v in zip(y, y[1:])))
            total += w
            good += w * np.array(y)
            for u, v in zip(y, y[1:]):
                pairs[u, v] += w
        assert np.allclose(got[a:b], good / total)
        count += pairs / total
    assert np.allclose(expected, count)


def corpus(spark, n=400):
    good = "A plain sentence about number {0}. It has another one, quite calm.\nAnd one more line of it."
    bad = "BUY {0}!! NOW!! FREE!!\nclick | here | win | {0}\nx$$$ y%%% z&&&"
    docs = [(k, (good if k % 3 else bad).format(k)) for k in range(n)] + [(9000, None), (9001, ""), (9002, "\n \n")]
    labels = [(k, int(k % 3 > 0), 0) for k in range(n)] + [(7, 0, 0), (None, 1, 0), (9001, None, 0)]
    return (spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS score", "1 AS _id"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_quality(spark):
    docs, labels = corpus(spark)
    field = quality.train(docs, labels, sample=150)
    rows = quality.classify(docs, field).select("_row.doc_id", "score", "predicted",
                                                quality.held_out(quality.F.col("_row.doc_id")).alias("held_out")).collect()
    assert len(rows) == 403 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 9000]
    assert len(held) > 50 and sum(r.predicted == (r.doc_id % 3 > 0) for r in held) / len(held) > 0.98
    assert len({r.score for r in rows if r.doc_id >= 9000}) == 1
    assert quality.classify(docs.limit(0), field).count() == 0
    blank = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.classify(docs.limit(5), blank).collect()} <= {0.5}


def test_held_out_labels_change_no_score(spark):
    docs, labels = corpus(spark, 120)
    held = quality.held_out(quality.F.col("doc_id"))
    turned = labels.withColumn("quality", quality.F.when(held, 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    one, two = quality.train(docs, labels), quality.train(docs, turned)
    assert np.array_equal(one.weights, two.weights) and one.bias == two.bias


PERSONAL = [None, "", "+1 (234) 567-8901 x", "\U0001f600 a@b.c_d@e.f 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255", "a" * 20_000,
            "1" * 20_000, "+1" * 2_000, "1-" * 5_000, "a@b.co " * 700, "4111 1111 1111 1111, 4111-1111-1111-1112",
            "x@y.zz x@y.zz\nx@y.zz", "a+b%c@d-e.f-g.h"]


def test_personal_data(spark):
    import random
    rnd = random.Random(2)
    texts = PERSONAL + ["".join(rnd.choice("a1@.+ -()b\n2\U0001f600") for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    texts += ["".join(rnd.choice("12345 -.+") for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS base", "1 AS spans")
    rows = {r.doc_id: r for r in pii.find(df.repartition(4)).collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        want = brute.pii(None if len(t or "") == 20_000 and t[0] == "a" else t) if t != "1" * 20_000 else ""
        base = ",".join(s for s in rows[k].spans.split(",") if not s.startswith("term"))
        assert base == want and rows[k].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        kinds = [s.split(":")[0] for s in want.split(",")]
        assert [rows[k][f"n_{kind}"] for kind in brute.PII] == [kinds.count(kind) for kind in brute.PII]
    assert pii.find(df.limit(0)).count() == 0


def test_terms_that_disclose(spark):
    rows = [(k, f"Zorblatt wrote number {k} today from bob@x.org ok") for k in range(8)]
    rows += [(100 + k, "Copied line of Quux with ann@x.org") for k in range(50)]           # one line, however often
    rows += [(200 + k, f"line {k} wrote number today from ok") for k in range(200)]
    rows += [(500, "Zorblatt again, bob@x.org"), (501, "Zorblatt alone"), (502, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find(df).collect()}
    assert spans[0] == "term:0:8,email:35:44" and spans[500] == "term:0:8,email:16:25"
    assert spans[100] == "email:25:34" and spans[200] == spans[501] == ""
    texts = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert texts[0] == "[TERM] wrote number 0 today from [EMAIL] ok"
    assert texts[501] == "Zorblatt alone" and texts[502] is None


def test_terms_by_mutual_information(spark):
    """Against counts over all distinct lines, entities and terms taken one by one."""
    rnd = random.Random(4)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = []
    for k in range(700):
        lines = []
        for _ in range(rnd.randint(1, 3)):
            line = rnd.choices(words, k=rnd.randint(3, 6))
            for who in rnd.sample(range(12), rnd.choice([0, 0, 0, 1, 2])):
                line += [f"u{who}@x.org"] + ([f"alias{chr(97 + who)}"] if rnd.random() < 0.9 else [])
            lines.append(" ".join(line))
        rows.append((k, "\n".join(lines)))
    rows += rows[:200] + [(900, f"many {' '.join(f'v{k}@y.org' for k in range(3000))} addresses"), (901, None), (902, "")]
    lines = {line for _, t in rows if t is not None for line in t.split("\n")}
    held = {line: ({w for w in line.split() if "@" in w}, {w for w in line.split() if "@" not in w}) for line in lines}
    tried = sum(len(e) * len(t) for e, t in held.values() if e)
    n, n_e, n_t, n_both = len(lines), Counter(), Counter(), Counter()
    for e, t in held.values():
        n_e.update(e), n_t.update(t), n_both.update(itertools.product(e, t))
    want = set()
    for (e, t), k in n_both.items():
        apart = n_e[e] - k
        ways = k * math.log2(n_e[e] / k) + (apart * math.log2(n_e[e] / apart) if apart else 0)
        unlikely = k * math.log2(n / n_t[t]) - ways >= math.log2(tried / pii.CHANCE)
        if math.log2(k * n / (n_e[e] * n_t[t])) >= 0.9 * math.log2(n / n_e[e]) and (k >= 5 or k >= 2 and unlikely):
            want.add(("email:" + e, t))
    got = pii.disclosing_terms(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(want) >= 8 and sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("n", [2, 6])
def test_a_name_in_its_own_address_discloses(spark, n):
    rows = [(k, f"Jane Doe wrote note {'abcdef'[k]} jane.doe@x.org") for k in range(n)]
    rows += [(50, "Solitary Quux wrote ann@x.org")]                    # one line is no evidence
    rows += [(100 + k, f"line {k} wrote note a b c d e f") for k in range(200)]
    spans = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(spans[k] == "term:0:4,term:5:8,email:22:36" for k in range(n))
    assert spans[50] == "email:20:29" and spans[100] == ""


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_on_edge_rows(spark, docs, texts):
    columns = docs.columns
    for name in ("near_copies", "repeats", "personal_data"):
        out = stage(name)(spark, docs, SF)
        assert out.columns == columns
        assert stage(name)(spark, docs.limit(0), SF).count() == 0
    kept = {r.doc_id for r in stage("near_copies")(spark, docs, SF).collect()}
    assert kept == {k for k, v in brute.similar(list(enumerate(texts))).items() if v[1] == k}
    rows = {r.doc_id: r for r in stage("repeats")(spark, docs, SF).collect()}
    for k, want in enumerate(brute.repeats(texts, 400)):
        if (texts[k] or "").isascii():
            assert hashlib.sha256(rows[k].text.encode()).hexdigest() == want[3] and rows[k].n_chars == want[0] - want[1]
    again = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "z"), (None, "z")],
                                  "doc_id long, text string")
    assert sorted((r.doc_id for r in stage("near_copies")(spark, again, SF).collect()), key=str) == [1, None, None]


def test_a_repeated_id_loses_only_the_text_that_is_a_copy(spark):
    one, two, own = ("a b c d e f g h", "k l m n o p q r", "s t u v w x y z")
    rows = [(3, one), (7, own), (7, one), (5, two), (4, two), (4, own + " 1 2 3 4 5 6 7 8 9"), (None, one), (6, ""), (6, "")]
    out = stage("near_copies")(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), SF)
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted(
        [(3, one), (7, own), (4, two), (4, rows[5][1]), (0, one), (6, "")])


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_near_copies_with_clashing_names(spark):
    """Columns with names that the stage uses inside, with and without repeated doc_ids."""
    words = " ".join(f"w{k}" for k in range(40))
    rows = [(1, words, 1, 2, 3, 4, 5), (2, words, 6, 7, 8, 9, 10), (3, "quite another text of its own here", 1, 1, 1, 1, 1)]
    kind = "doc_id long, text string, _gone int, _no int, _twice int, count int, _row int"
    for more, kept in (([], [1, 3]), ([(3, words + " more", 0, 0, 0, 0, 0), (3, rows[2][1], 2, 2, 2, 2, 2)], [1, 3])):
        df = spark.createDataFrame(rows + more, kind)
        out = stage("near_copies")(spark, df, SF)
        assert out.columns == df.columns
        got = sorted(out.collect())
        assert [r.doc_id for r in got] == kept and tuple(got[0]) == rows[0]


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "repeats", "personal_data", "packing"]
    out = corpus_pipeline.run(spark, SF)
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    bad, good = [[k for k, v in labels.items() if v == q] for q in (0, 1)]
    assert len(ids & set(bad)) <= 0.1 * len(bad)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    component = brute.similar(list(texts.items()))
    lone = [k for k in good if sum(c == component[k] for c in component.values()) == 1]
    assert len(ids & set(lone)) >= 0.98 * len(lone)
