"""Similarity join, suffix dedup, vectors and fingerprints against plain versions."""

import hashlib
import random

import numpy as np
import pytest

import brute
from pyspark.sql import DataFrameWriter, Window
from pyspark.sql import functions as F

from feedlens.llm import fingerprints, jaccard, repeats, vectors
from feedlens.llm.components import components


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1200)]
    groups = brute.Groups({x for e in edges for x in e})
    for a, b in edges:
        groups.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == groups.find(x) for x in groups.up)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("settings", [{}, {"RARE_SETS": 1, "MAX_BROADCAST_IDS": 0, "MEMBERS_PER_TASK": 3},
                                      {"MAX_COMMON": 20, "FLUSH": 500, "LONGER": 2}])
def test_similar_documents(docs, texts, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(jaccard, name, value)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs).collect()}
    assert got == brute.similar(list(enumerate(texts)))


@pytest.mark.parametrize("settings", [{}, {"RARE_SETS": 1}, {"RARE_SETS": 2, "COMBINE": 2}, {"RARE_SETS": 3, "LONGER": 4, "PART_TOKENS": 300}])
def test_links_are_found_without_leaders(docs, texts, monkeypatch, settings):
    """All links by the index alone, whichever entries are extended: no leader is ever compared."""
    for name, value in settings.items():
        monkeypatch.setattr(jaccard, name, value)
    got = {r.doc_id: r.component_id for r in jaccard.similar_documents(docs, star_rounds=0).collect()}
    assert got == {k: v[1] for k, v in brute.similar(list(enumerate(texts))).items()}


def test_a_shared_template_gives_few_pairs(spark, monkeypatch):
    """A third of all rows share 70 % of their words, which links none of them: candidates grow
    with the rows, not with their square, and the links between others are found."""
    rnd = random.Random(6)
    template = [f"t{k}" for k in range(140)]
    rows = [template + [f"own{k}_{j}" for j in range(60)] for k in range(150)]
    rows += [[f"w{rnd.randrange(5_000)}" for _ in range(120)] for _ in range(200)]
    rows += [r[:110] + [f"end{k}"] * 2 for k, r in enumerate(rows[150:250])]       # most of them link
    texts = [" ".join(r) for r in rows]
    pairs = []
    found = jaccard._candidates
    monkeypatch.setattr(jaccard, "_candidates", lambda *a: pairs.append(found(*a)) or pairs[0])
    monkeypatch.setattr(jaccard, "release", lambda *a: None)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard.similar_documents(df, star_rounds=0).collect()}
    want = brute.similar(list(enumerate(texts)))
    assert got == {k: v[1] for k, v in want.items()} and len(set(got.values())) < len(texts) - 50
    assert pairs[0].count() < 3 * len(texts)


def test_copies_about_the_threshold_are_compared_with_leaders(spark, monkeypatch):
    """Of 250 copies of a text, changed so that about a fifth of the pairs link, few pairs are compared."""
    rnd = random.Random(8)
    base = [f"t{k}" for k in range(182)]
    texts = []
    for k in range(250):
        own = list(base)
        for at in rnd.sample(range(182), 2):
            own[at] = f"own{k}_{at}"
        texts.append(" ".join(own))
    want = brute.similar(list(enumerate(texts)))
    compared = []
    linked = jaccard._linked
    monkeypatch.setattr(jaccard, "_linked", lambda pairs, *a: compared.append(pairs.count()) or linked(pairs, *a))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(df, star_rounds=0).collect()}
    assert got == want and sum(compared) < 250 * 40, compared


def test_similar_documents_defined_cases(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (5, "A b c d\te f"), (None, "a b c d e f"), (9, "q"), (8, "q"), (7, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_documents(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(3, 2, 3), (3, 2, 3), (5, 2, 3), (None, 2, None), (9, 1, 8), (8, 1, 8), (7, 0, 7)], key=str)
    assert jaccard.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_remove_repeats(docs, texts, monkeypatch, broadcast):
    monkeypatch.setattr(repeats, "MAX_BROADCAST_BYTES", broadcast)
    rows = {r["_row"].doc_id: r for r in repeats.remove_repeats(docs, 100).collect()}
    for k, want in enumerate(brute.repeats(texts, 100)):
        r = rows[k]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want
        assert r["_row"].row == "x" and len(r.text.encode()) <= r.n_bytes - r.n_removed


def test_remove_repeats_by_400_bytes(spark):
    rnd = random.Random(4)
    base = "".join(rnd.choice("abcdé ") for _ in range(1500))
    texts = ["".join(rnd.choice("xyz ") for _ in range(rnd.randint(0, 200))) + base[a:a + rnd.randint(300, 700)]
             for a in (rnd.randint(0, 900) for _ in range(25))]
    texts += ["a" * 1000, "a" * 399 + "b", "ab" * 600, base[:400], base[:400], base[:399], "q" * 400, None, "", "q" * 401]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = {r["_row"].doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
            for r in repeats.remove_repeats(df).collect()}
    assert [rows[k] for k in range(len(texts))] == brute.repeats(texts, 400)
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def test_windows_point_to_their_least_gram():
    rng = np.random.default_rng(3)
    buf = rng.integers(97, 100, 3000).astype(np.uint8)
    docs = np.array([0, 50, 50, 1200, 1350, 3000])
    text, at, lo, n, gram = repeats.pointers(buf, docs, 100)
    spans = repeats.Spans(buf)
    seen = 0
    for d, a, first, count, g in zip(text, at, lo, n, gram):
        for p in range(first, first + count):
            where = np.arange(p, p + 100 - repeats.GRAM + 1)
            ids = spans.ids(where, where + repeats.GRAM).view(np.uint64) >> np.uint64(32)
            assert where[int(ids.argmin())] == a and docs[d] <= p and p + 100 <= docs[d + 1]
            seen += 1
    assert seen == sum(max(0, s - 99) for s in np.diff(docs))


@pytest.mark.parametrize("dims, noise", [(3, 0.3), (8, 0.05)])
@pytest.mark.parametrize("small", [{}, {"rows_per_cell": 20, "part_rows": 10}])
def test_near_vectors(spark, dims, noise, small):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, dims))
    rows = [(k, (base[rng.integers(30)] + noise * rng.normal(size=dims)).tolist(), int(rng.integers(3))) for k in range(250)]
    rows += [(400, [0.0] * dims, 1), (401, None, 1), (402, [float("nan")] * dims, 1), (403, [1.0] * dims, None),
             (404, [1.0, None] + [1.0] * (dims - 2), 1), (405, [1.0, 2.0], 1), (406, [1.0, 2.0], 1),
             (407, rows[0][1], rows[0][2]), (408, [], 2), (409, [float("inf")] * dims, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' AS row", "1 AS cell")
    got = vectors.near_vectors(df.repartition(4), **small).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute.vectors(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert vectors.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [0.98, 1 - 1e-9])
def test_scaled_copies_over_many_pivots(spark, monkeypatch, threshold):
    """Pivots that point the same way, kept or merged, lose no link."""
    rng = np.random.default_rng(1)
    one = rng.normal(size=64)
    rows = [(k, (one * rng.uniform(0.1, 9)).tolist() if k % 3 else rng.normal(size=64).tolist(), 1) for k in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for merged in (True, False):
        if not merged:
            monkeypatch.setattr(vectors, "_spread", lambda pivots, least: pivots)
        got = vectors.near_vectors(df.repartition(4), threshold, rows_per_cell=2, part_rows=16).collect()
        group = {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id % 3}
        assert set(group.values()) == {(99, 1)} and len(group) == 100
        assert all((r.n_links, r.component_id) == (0, r.vec_id) for r in got if r.vec_id % 3 == 0)


def test_copies_of_a_vector_are_joined_as_one(spark, monkeypatch):
    rng = np.random.default_rng(2)
    one = rng.normal(size=16)
    rows = [(k, one.tolist() if k % 3 == 0 else rng.normal(size=16).tolist(), 1) for k in range(150)]
    rows += [(200, (one * 2 + 1e-3).tolist(), 1), (201, one.tolist(), 2), (202, one.tolist(), 2)]
    sent, linked = [], vectors.linked_rows
    monkeypatch.setattr(vectors, "linked_rows", lambda v, *more: (sent.append(v.count()), linked(v, *more))[1])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = vectors.near_vectors(df.repartition(4), rows_per_cell=10, part_rows=16).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute.vectors(rows)
    assert sent == [103]


def test_vectors_over_many_rounds(spark, monkeypatch):
    """Labels over several rounds and parts, near copies in all of them, odd lengths and copies."""
    for name, value in (("ROUND_BYTES", 15_000), ("PART_BYTES", 4_000), ("TILE", 8), ("TILES", 3), ("SAMPLE", 40)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 20))
    rows = [(int(rng.integers(400)), (base[k % 6] + rng.choice([0.01, 1.0]) * rng.normal(size=20)).tolist(), int(rng.choice([1, 1, 1, 2, k])))
            for k in range(400)]
    rows += [(500 + k, rows[k % 7][1], 1) for k in range(30)] + [(600 + k, rows[k][1][:k % 3 + 1], 1) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    sent, cut = [], vectors.Round.__init__
    monkeypatch.setattr(vectors.Round, "__init__", lambda self, *a: (cut(self, *a), sent.append(self))[0])
    got = vectors.near_vectors(df.repartition(5), part_rows=16, rows_per_cell=10).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute.vectors(rows)
    assert len(sent) > 5 and sum(len(r.row) for r in sent) == len({(tuple(v), label) for _, v, label in rows})
    single = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    got = vectors.near_vectors(df.selectExpr("vec_id", "cast(embedding AS array<float>) AS embedding", "label")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute.vectors(single)


def test_vectors_are_written_a_bounded_number_of_times(spark, monkeypatch):
    """No scratch table holds a vector more than once, however many cells or tiles there are."""
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=24).tolist(), k % 2) for k in range(600)]
    wrote, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: (wrote.append(path), write(self, path, *a, **b))[1])
    monkeypatch.setattr(vectors, "release", lambda *a: None)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = vectors.near_vectors(df, rows_per_cell=10, part_rows=20).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute.vectors(rows)
    tables = [spark.read.parquet(path) for path in wrote]
    held = [t.count() for t in tables if {"embedding", "vec"} & set(t.columns)]
    assert held and max(held) == len(rows)


def test_fingerprints(spark, docs, texts):
    got = {r.doc_id: r for r in fingerprints.fingerprint(docs).collect()}
    off = []
    for k in reversed(range(len(texts))):
        text, after, r = texts[k] or "", texts[k - 1] or "", got[k]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = brute.shingles(text), brute.shingles(other)
            off.append(near - (len(a & b) / len(a | b) if a | b else 1.0))
            assert 0 <= near <= 1
    assert np.sqrt(np.mean(np.square(off))) < 0.05 and abs(np.mean(off)) < 0.01
    same = {}
    for k, t in enumerate(texts):
        same.setdefault(t or "", set()).add(got[k].fingerprint)
    assert all(len(v) == 1 for v in same.values())
    assert fingerprints.fingerprint(docs.limit(0)).count() == 0


def test_fingerprint_order_over_many_ranges(spark, monkeypatch):
    rows = [(k * 7 % 101, f"t{k}") for k in range(60)] + [(None, "n"), (5, "x"), (5, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = fingerprints.with_next(df, per_range=4)
    assert made.where("_extra = 1").count() == made.select("_range").distinct().count() > 5
    assert fingerprints.fingerprint(df).count() == len(rows)


@pytest.mark.parametrize("far", [[], [(1 << 62, "far"), (-(1 << 62), "low"), (-(1 << 63), "least")]])
def test_fingerprint_ranges_go_by_depth(spark, far):
    """Outlying ids and many null ids crowd no range, and every row meets its next row."""
    rows = [(k, f"t{k}") for k in range(300)] + [(None, f"n{k}") for k in range(300)] + far
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    made = fingerprints.with_next(df, per_range=20)
    sizes = [r["count"] for r in made.where("_extra = 0").groupBy("_range").count().collect()]
    assert sum(sizes) == len(rows) and len(sizes) > 20 and max(sizes) < 80
    after = Window.partitionBy("_range").orderBy("_extra", F.desc_nulls_last("doc_id"), F.desc("_hash"))
    pairs = {r.text: r.nxt for r in made.withColumn("nxt", F.lead("text").over(after)).where("_extra = 0").collect()}
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = [t for _, t in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -hashes[r[1]]))]
    assert pairs == dict(zip(order, order[1:] + order[:1]))


def test_tiny_and_huge_vectors_link(spark):
    rows = [(1, [1.0, 2.0], 0), (2, [1e-170, 2e-170], 0), (3, [1e200, 2e200], 0), (4, [5e-324, 0.0], 0), (5, [1.0, 0.0], 0), (6, [2.0, -1.0], 0)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute.vectors(rows) == [
        (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 4), (5, 1, 4), (6, 0, 6)]
