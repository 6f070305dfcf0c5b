"""Hard negatives, mixing and fill-in-the-middle against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute
from feedlens.llm import fim, mixing, negatives

VECTORS = "vec_id long, embedding array<double>, label int, row string, dims string"


def _clustered(rnd, n, dims=6, spread=0.05):
    centres = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(8)]
    return [(k, [x + rnd.gauss(0, spread) for x in rnd.choice(centres)], rnd.randrange(3), "x", "y") for k in range(n)]


def _mined(spark, rows, **options):
    found = negatives.hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(3), **options)
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found.collect())


@pytest.mark.parametrize("settings", [{}, {"ROUND_BYTES": 2_000, "SLICE": 16}])
def test_hard_negatives(spark, monkeypatch, settings):
    """Clustered vectors, ties and unusable rows; trees of many and of few anchors, many rounds."""
    for name, value in settings.items():
        monkeypatch.setattr(negatives, name, value)
    rnd = random.Random(7)
    rows = _clustered(rnd, 400)
    rows[20:40] = [(k, list(rows[0][1]), k % 2, "x", "y") for k in range(20, 40)]          # ties
    rows[40:46] = [(40, None, 1, "x", "y"), (41, [1.0] * 6, None, "x", "y"), (42, [math.nan] * 6, 1, "x", "y"),
                   (43, [None, 1.0, 1.0, 1.0, 1.0, 1.0], 1, "x", "y"), (44, [], 1, "x", "y"), (45, [math.inf] * 6, 1, "x", "y")]
    rows[46:48] = [(46, [0.0] * 6, 1, "x", "y"), (50, [0.0] * 6, 2, "x", "y")]
    rows[48:50] = [(48, [1.0, 2.0], 1, "x", "y"), (10, [2.0, 1.0], 2, "x", "y")]           # another length
    want = brute.negatives([(i, v, s) for i, v, s, *_ in rows], 10)
    assert _mined(spark, rows, every=10, block=8) == want and len(want) > 100


def test_hard_negatives_bounds_leave_candidates_out(spark, monkeypatch):
    """Near anchors in one tree: most candidates are ruled out without a score."""
    rnd = random.Random(1)
    rows = _clustered(rnd, 3_000, dims=16, spread=0.001)
    f = spark.createDataFrame(rows, VECTORS)
    held = []
    part = negatives.scaled(f).where("id % 10 = 0")
    nodes = negatives.trees(part, held, 64).toPandas().sort_values("place")
    nodes["wanted"] = [[] for _ in range(len(nodes))]
    scored = Counter()
    plain = negatives.Tree.scores

    def counted(self, k, m, *rest):
        scored["all"] += len(m)
        return plain(self, k, m, *rest)

    monkeypatch.setattr(negatives.Tree, "scores", counted)
    c = negatives.scaled(f).toPandas()
    for _, block in nodes.groupby(["dims", "centre", "part"]):
        tree = negatives.Tree(block, True, 5)
        for s in range(0, len(c), 300):
            some = c[s:s + 300]
            tree.meet(negatives._matrix(some["v"]), some["label"].to_numpy(), some["id"].isna().to_numpy(),
                      some["id"].to_numpy(), some["row"].to_numpy())
    assert scored["all"] < 0.5 * len(nodes) * len(c)


def test_hard_negatives_large_components(spark):
    rnd = random.Random(3)
    rows = [(k, [rnd.uniform(-1, 1) * 2.0 ** 20 for _ in range(4)], k % 3, "x", "y") for k in range(60)]
    assert _mined(spark, rows, every=10) == brute.negatives([(i, v, s) for i, v, s, *_ in rows], 10)
    huge = [(k, [1e30 * (k + 1), 1.0], k % 2, "x", "y") for k in range(12)]
    assert _mined(spark, huge, every=10)


def test_hard_negatives_defined_cases(spark):
    rows = [(0, [1.0, 0.0], 1, "x", "y"), (0, [1.0, 0.0], 1, "x", "y"), (None, [1.0, 0.0], 2, "x", "y"), (5, [1.0, 0.0], 2, "x", "y")]
    got = _mined(spark, rows)
    assert got == sorted([(0, 0, 1, 5, 65536, 65536), (0, 0, 2, None, 65536, 65536)] * 2, key=lambda r: r[:3])
    assert _mined(spark, []) == [] and _mined(spark, rows[2:]) == []


# ---------------------------------------------------------------- mixing

def _mixture(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, m long").repartition(4)
    return df, mixing.mix_documents(df, **options)


def _corpus(rnd):
    rows, sources = [], ["a", "b", "B", "ä", None, "z", ""]
    for k in range(900):
        source = "z" if rnd.random() < 0.35 else rnd.choice(sources)
        rows.append((k, " ".join(["w"] * int(rnd.lognormvariate(3, 1)) ), source, "x", 1))
    return rows + [(2000, None, "a", "x", 1), (2001, " \t", "only empty", "x", 1), (None, "one two", "b", "x", 1)] \
        + [(3000, "the same words again", "b", "x", 1)] * 40


@pytest.mark.parametrize("slots", [200_000, 7])
def test_mixture(spark, slots):
    rows = _corpus(random.Random(5))
    df, mixed = _mixture(spark, rows, rows_per_slot=slots)
    got = mixed.collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter(
        (i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s, *_ in rows)
    sizes = Counter()
    for r in got:
        sizes[r.source] += r.size
    want = brute.mixture_targets(sizes, (5, 2, 1), 3)
    taken, tilted, of = Counter(), Counter(), {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12)
        assert 0 <= r.copies <= 3
        taken[r.source] += r.size * r.copies
        tilted[r.source] += r.size * r.rate
        of.setdefault(r.source, {})[r.size] = r.rate
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.01 * t + 1 and tilted[s] == pytest.approx(t, rel=1e-5)
        # One multiplier a source: the rate is its exponential tilt, or the bound.
        free = [(math.log(v) / n) for n, v in of[s].items() if n and 1e-200 < v < 3 - 1e-9]
        assert not free or max(free) - min(free) < 1e-9
    again = sorted(mixed.collect(), key=str)
    assert sorted(_mixture(spark, rows[::-1], rows_per_slot=slots)[1].collect(), key=str) == again
    assert Counter(r.text for r in mixing.repeated(df, mixed).collect()) == Counter(
        {t: n for t, n in _texts(rows, got).items() if n})


def _texts(rows, got):
    """Copies by text, from copies by (doc_id, source)."""
    text = {(i, s): t for i, t, s, *_ in rows}
    out = Counter()
    for r in got:
        out[text[r.doc_id, r.source]] += r.copies
    return out


def test_mixture_hot_size_and_extremes(spark):
    """A third of the rows of one source and size; a source far above, one far below its share."""
    rows = [(k, "a b c", "hot", "x", 1) for k in range(400)] + [(1000 + k, "w " * (k + 1), "low", "x", 1) for k in range(300)] \
        + [(5000 + k, "w " * 9, "rich", "x", 1) for k in range(10)]
    _, mixed = _mixture(spark, rows, rows_per_slot=10, weights=(1, 1, 200))
    by = {r.source: r for r in mixed.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("t"), F.min("copies").alias("least")).collect()}
    assert by["rich"].least == 3 and by["rich"].taken == by["rich"].t == 270
    assert all(abs(r.taken - r.t) <= 0.01 * r.t for r in by.values())
    for rows in ([], [(1, None, "a", "x", 1), (2, "", None, "x", 1)]):
        assert [(r.size, r.target, r.copies) for r in _mixture(spark, rows)[1].collect()] == [(0, 0.0, 1)] * len(rows)


# ---------------------------------------------------------------- fill in the middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def _middle(doc_id, text):
    text = text or ""
    units = TOKEN.findall(text)
    d = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or any(x in text for x in fim.MARKERS) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, texts):
    rnd = random.Random(11)
    hard = ["".join(rnd.choice("<PSM> a\té\U0001f600\n") for _ in range(rnd.randrange(40))) for _ in range(400)]
    hard += ["<S", "a <S", "S> b <", "<P", "  lead", "trail  \n", "x" * 200_000, "y " * 300_000, "a<M>b", "<<P", "<P<S<M "]
    rows = [(k, t, "r", "f") for k, t in enumerate(texts + hard)] + [(None, "no id here at all", "r", "f"), (3, "x y", "r", "f"), (3, "x y", "r", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string, form string").repartition(4)
    got = fim.restore(fim.fill_in_middle(df))
    seen = Counter()
    for r in got.collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == _middle(r["_row"].doc_id, r["_row"].text)
        assert r.restored == (r["_row"].text or "") and r["_row"].n == "r"
        seen[r.form] += 1
    assert sum(seen.values()) == len(rows) and min(seen[x] for x in ("plain", "psm", "spm")) > 20
    assert fim.restore(fim.fill_in_middle(df.limit(0))).count() == 0


def test_fill_in_middle_parameters(spark):
    df = spark.createDataFrame([(k, "abcdefgh") for k in range(50)], "doc_id long, text string")
    marks = ("[pre]", "[suf]", "[mid]")
    got = fim.restore(fim.fill_in_middle(df, seed=1, rate=100, spm=0, markers=marks, unit="[a-z]"), marks).collect()
    assert {r.form for r in got} == {"psm"} and {r.n for r in got} == {8} and {r.restored for r in got} == {"abcdefgh"}
    assert len({r.prefix_chars for r in got}) > 3
    odd = fim.fill_in_middle(df, unit="[0-9]").first()
    assert odd.n == 1


# ---------------------------------------------------------------- SQL twins

@pytest.mark.parametrize("name", ["op11_negatives", "op13_middle"])
def test_query_matches_its_sql(spark, name):
    import duckdb
    from feedlens.llm import ORACLE, QUERIES
    path = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/{table}.parquet')")
    got = QUERIES[name](spark, path)
    want = con.execute(ORACLE[name])
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
