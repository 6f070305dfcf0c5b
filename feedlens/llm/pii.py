"""Personal data: exact base kinds, then terms that disclose them by corpus co-occurrence.

Native throughout. A kind's matches and the pieces between them come from one pattern by
``regexp_extract_all`` and ``split``, so positions are running sums of their lengths.
The patterns are those of the contract with possessive loops, and a run of characters is
tried from its start only (every later start of the same run fails as well), which keeps
them linear on long runs.

The information-theoretic step works on distinct lines, so copies of a document count
once. An entity is a base match. A term discloses it when their pointwise mutual
information reaches ``alpha`` of the entity's information content,
log2(p(e, t) / (p(e) p(t))) >= alpha * -log2 p(e), and the lines they share are evidence:
``min_lines`` distinct ones, or at least two whose number chance does not explain. For
that, the chance of k shared lines is at most C(n_e, k) (n_t / n)^k, and the sum of it over
all pairs that are tried must stay below ``CHANCE``. One shared line is no evidence: each
rare word of the line would have the full information. A term may be part of the entity's
spelling, such as a name in an address. Such terms are spans of kind ``term`` in the
documents that hold the entity, and nowhere else.

Defined cases: a null or empty text has no spans; repeated rows get the same spans; an
empty table gives an empty result; further columns do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import materialise

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without this has no match of the kind.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
TERM = r"[^\s]+"
BLOCK = 256
CHANCE = 0.01
MAX_BROADCAST_TERMS = 1_000_000   # hashes of terms that every task may get, so that other words need no shuffle


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where a lambda uses it again and again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _luhn(digits: Column) -> Column:
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(
        i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return _let(_digits(match), lambda d: F.when(F.char_length(d).between(14, 19), _luhn(d)).otherwise(False))
    return F.char_length(_digits(match)).between(10, 15)


def _running(lengths: Column) -> Column:
    """Running sums of an int array, by blocks, so long arrays don't cost their square."""
    zero = F.lit(0).cast("long")

    def total(x: Column, start: Column, n: Column) -> Column:
        return F.aggregate(F.slice(x, start, n), zero, lambda a, y: a + y)

    def sums(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")),
                             lambda b: total(x, b * BLOCK + 1, F.lit(BLOCK)))
        before = F.aggregate(blocks, F.array(zero), lambda a, y: F.concat(a, F.array(F.element_at(a, -1) + y)))
        return _let(before, lambda at: F.transform(
            x, lambda _, i: F.element_at(at, F.floor(i / BLOCK).cast("int") + 1) + total(x, i - i % BLOCK + 1, i % BLOCK + 1)))

    return _let(lengths, sums)


def _matches(df: DataFrame, text: str, pattern: str, name: str, when: Column) -> DataFrame:
    """Adds ``name``: array of (start, match) in code points, empty where ``when`` is not true."""
    value, start = f"{name}_m", f"{name}_e"
    df = df.withColumn(value, F.when(when, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
                       .otherwise(F.array().cast("array<string>")))
    some = F.size(value) > 0
    df = df.withColumn(start, F.when(some, F.transform(F.split(F.col(text), pattern, -1), F.char_length)))
    df = df.withColumn(start, F.when(some, _running(F.zip_with(
        F.col(start), F.col(value), lambda p, m: p + F.coalesce(F.char_length(m), F.lit(0))))))
    return df.withColumn(name, F.when(some, F.zip_with(
        F.slice(start, F.lit(1), F.size(value)), F.col(value),
        lambda e, m: F.struct((e - F.char_length(m)).alias("start"), m.alias("match")))).otherwise(
        F.array().cast("array<struct<start:bigint,match:string>>"))).drop(value, start)


def _is_valid(kind: str):
    return lambda s: _valid(kind, s["match"])


def _span(order: int, kind: str):
    """(start, match) as a span of this kind."""
    return lambda s: F.struct(
        s["start"].alias("start"), F.lit(order).alias("order"),
        (s["start"] + F.char_length(s["match"])).alias("end"),
        F.lit(kind).alias("kind"), s["match"].alias("match"))


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def base_spans(df: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """Adds ``name``: array of (start, order, end, kind, match), sorted by start, then kind as listed."""
    parts = []
    for k, kind in enumerate(KINDS):
        part = f"{name}_{kind}"
        need = F.col(text).contains("@") if kind == "email" else F.col(text).rlike(NEEDS[kind])
        df = _matches(df, text, PATTERNS[kind], part, need)
        df = df.withColumn(part, F.transform(F.filter(part, _is_valid(kind)), _span(k, kind)))
        parts.append(part)
    return df.withColumn(name, F.sort_array(F.concat(*parts))).drop(*parts)


def entity_of(span: Column) -> Column:
    """The protected value of a base span, in one spelling."""
    return F.concat_ws(":", span["kind"], F.when(span["kind"] == "email", F.lower(span["match"]))
                       .when(span["kind"] == "ip", span["match"]).otherwise(_digits(span["match"])))


def term_of(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def _terms(line: Column) -> Column:
    return F.filter(F.array_distinct(F.transform(F.split(line, r"\s+"), term_of)),
                    lambda t: t.rlike(r"\p{L}") & ~t.contains("@"))


def disclosing_terms(docs: DataFrame, min_lines: int = 5, alpha: float = 0.9,
                     text: str = "text") -> DataFrame | None:
    """(entity, term) pairs over the threshold, from all distinct lines of the corpus;
    None when no entity shares enough lines with any term."""
    least = min(2, min_lines)
    texts = docs.select(F.col(text).alias("_t"))
    lines = texts.where(F.col("_t").contains("@") | F.col("_t").rlike(r"[0-9][\x20.()-]?[0-9]")) \
        .select(F.explode(F.split("_t", "\n")).alias("_line")) \
        .where(F.col("_line").contains("@") | F.col("_line").rlike(r"[0-9][\x20.()-]?[0-9]"))
    found = base_spans(lines, "_line", "_spans").where(F.size("_spans") > 0) \
        .select(F.xxhash64("_line").alias("line"), F.array_distinct(F.transform("_spans", entity_of)).alias("entities"),
                "_line")
    # One row per distinct line; entities and terms meet by its id, so its text stays single.
    lines = materialise(found.groupBy("line").agg(F.first("entities").alias("entities"), F.first("_line").alias("_line")),
                        "pii-lines")
    pairs = lines.select("line", F.explode("entities").alias("entity"))
    # Entities in a single line end here.
    often = pairs.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= least)
    words = lines.select("line", F.explode(_terms(F.col("_line"))).alias("term"))
    both = materialise(pairs.join(often, "entity").join(words, "line")
                       .groupBy("entity", "term").agg(F.first("n_e").alias("n_e"), F.count("*").alias("n_both"))
                       .where(F.col("n_both") >= least), "pii-both")
    if both.isEmpty():
        return None
    n = F.lit(float(texts.select(F.explode(F.split("_t", "\n")).alias("_line"))
                    .select(F.xxhash64("_line").alias("line")).distinct().count()))
    # The threshold bounds the lines a term may stand in. Lines with personal data are part
    # of them, so a term over the bound there needs no count over the corpus.
    bound = F.col("n_both") * F.pow(n / F.col("n_e"), 1 - alpha)
    tried = lines.agg(F.sum(F.size("entities") * F.size(_terms(F.col("_line"))).cast("long")).alias("n")).first()["n"]
    k, apart = F.col("n_both"), F.col("n_e") - F.col("n_both")
    # log2 C(n_e, k) by its entropy bound
    ways = k * F.log2(F.col("n_e") / k) + F.when(apart > 0, apart * F.log2(F.col("n_e") / apart)).otherwise(0.0)

    def holds(n_t: str) -> Column:
        unlikely = k * F.log2(n / F.col(n_t)) - ways >= F.log2(F.lit(tried / CHANCE))
        return (F.col(n_t) <= bound) & ((k >= min_lines) | unlikely)

    here = words.groupBy("term").agg(F.count("*").alias("n_here"))
    both = materialise(both.join(here, "term").where(holds("n_here")).drop("n_here"), "pii-both")
    wanted = both.select(F.xxhash64("term").alias("_term")).distinct()
    if wanted.count() <= MAX_BROADCAST_TERMS:
        wanted = F.broadcast(wanted)
    seen = texts.select(F.explode(F.split("_t", "\n")).alias("_line")) \
        .select(F.xxhash64("_line").alias("line"), F.explode(_terms(F.col("_line"))).alias("term")) \
        .join(wanted, F.xxhash64("term") == F.col("_term"), "left_semi") \
        .groupBy("term", "line").agg(F.lit(1).alias("_one")) \
        .groupBy("term").agg(F.count("*").alias("n_t"))
    return materialise(both.join(seen, "term").where(holds("n_t")).select("entity", "term"), "pii-terms")


def all_spans(docs: DataFrame, terms: DataFrame | None, text: str = "text") -> DataFrame:
    """``docs`` plus ``base`` and ``spans`` (base and term spans), both sorted arrays."""
    found = base_spans(docs, text, "base")
    if terms is None:
        return found.withColumn("spans", F.col("base"))
    key = F.md5(F.coalesce(F.col(text), F.lit("")))
    found = found.withColumn("_key", key)
    per_entity = terms.groupBy("entity").agg(F.collect_set("term").alias("_terms"))
    # Which terms a text may lose, by its key alone: the text is not sent once per entity.
    held = found.where(F.size("base") > 0) \
        .select("_key", F.explode(F.array_distinct(F.transform("base", entity_of))).alias("entity")).distinct() \
        .join(per_entity, "entity").groupBy("_key") \
        .agg(F.array_distinct(F.flatten(F.collect_set("_terms"))).alias("_terms"))
    found = _matches(found.join(held, "_key", "left"), text, TERM, "_words", F.col("_terms").isNotNull())
    found = found.withColumn("_extra", F.transform(
        F.filter("_words", lambda w: F.array_contains(F.col("_terms"), term_of(w["match"]))),
        _span(len(KINDS), "term")))
    # A word that a base span covers, or touches, needs no span of its own.
    return found.withColumn("spans", F.sort_array(F.concat(
        F.col("base"), F.coalesce(F.filter("_extra", lambda w: ~F.exists(
            F.col("base"), lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))),
            F.array().cast(found.schema["base"].dataType))))).drop("_key", "_terms", "_words", "_extra")


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find(docs: DataFrame, min_lines: int = 5, alpha: float = 0.9) -> DataFrame:
    """Per document: doc_id, counts by kind, base_sha256, spans."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = all_spans(docs, disclosing_terms(docs, min_lines, alpha))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"),
                        _listed("spans").alias("spans"))


def sanitise(docs: DataFrame, min_lines: int = 5, alpha: float = 0.9) -> DataFrame:
    """``docs`` with every span of ``text`` generalised to its kind, such as [EMAIL]; a
    null text stays null, other columns stay as they are."""
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("text").alias("_t"))
    found = all_spans(rows, disclosing_terms(docs.select("text"), min_lines, alpha), "_t")
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    cut = F.aggregate("spans", empty, lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when(s["start"] >= a["at"], F.concat(
            a["out"], F.substring(F.col("_t"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")),
            F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(a["out"]).alias("out")))
    found = found.withColumn("_cut", cut)
    text = F.when(F.size("spans") > 0, F.concat(
        F.col("_cut.out"), F.substring(F.col("_t"), (F.col("_cut.at") + 1).cast("int"), F.char_length("_t")))) \
        .otherwise(F.col("_t"))
    return found.select(*[text.alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in columns])
