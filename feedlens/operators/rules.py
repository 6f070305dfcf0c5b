"""Rule tagger (T6): an offline, deterministic stand-in for the remote model.

Ordered keyword rules assign the primary tag (the first rule that fires) and
the secondary tag (the next one); categories are the category words the text
contains; sentiment and ``explored_new`` come from word lists. Words match as
whole words of the lower-cased text ("late" is not in "chocolate"; a word that
ends in ``*`` matches as a beginning), or anywhere for books that say so
(``whole_words=False``). The same book gives the same tags in Spark SQL
(``rule_tag``) and in Python (``RuleTagger``, the callable the batch job ships to
executors).

The default book is ours (the reference's model has no rules); its categories are
the codebook's, with one of our own.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlens import codebook as cb


@dataclass(frozen=True)
class RuleBook:
    rules: list[tuple[str, list[str]]]
    categories: list[str]
    explored: list[str]
    positive: list[str]
    negative: list[str]
    default_tag: str = cb.NOISE_TAG
    default_sentiment: str = "mixed"
    tags: list[str] = field(default_factory=lambda: list(cb.PRIMARY_TAGS))
    whole_words: bool = True


def _pattern(words: list[str]) -> str:
    """A pattern, the same in Java and Python, for any of the words as whole words."""
    ends = [re.escape(w[:-1]).replace("\\ ", " ") if w.endswith("*")
            else re.escape(w).replace("\\ ", " ") + "(?![a-z0-9_])" for w in words]
    return "(?<![a-z0-9_])(?:" + "|".join(ends) + ")"


# A category of our own, besides the codebook's.
OWN_CATEGORIES = ["beauty"]


REVIEW_BOOK = RuleBook(
    rules=[
        ("TRUST_AUTHENTICITY", ["fake", "counterfeit", "duplicate product", "not genuine"]),
        ("TRUST_QUALITY", ["rotten", "stale", "expired", "spoiled", "not fresh", "damaged"]),
        ("PRICE_VALUE", ["cheaper", "expensive", "overpriced", "price compar*", "discount"]),
        ("MENTAL_MODEL", ["emergency", "last minute", "only for urgent", "instant need"]),
        ("DISCOVERY_GAP", ["didn't know", "did not know", "can't find", "couldn't find"]),
        ("INFO_GAP", ["more details", "no information", "ingredients", "want reviews"]),
        ("HABIT_AUTOPILOT", ["every week", "every day", "same items", "reorder", "always order"]),
    ],
    categories=list(dict.fromkeys([*cb.EXAMPLE_CATEGORIES, *cb.CATEGORY_ALIASES, *cb.PERISHABLE,
                                   *OWN_CATEGORIES])),
    explored=["first time", "tried new", "for the first", "never bought before"],
    positive=["great", "good", "love", "excellent", "fast", "happy"],
    negative=["bad", "worst", "rotten", "fake", "late", "refund", "never", "poor"],
)


def _any_contains(low: Column, words: list[str], whole: bool) -> Column:
    hit = F.lit(False)
    if whole and words:
        return low.rlike(_pattern(words))
    for w in words:
        hit = hit | low.contains(w)
    return hit


def rule_tag(text: Column | str, book: RuleBook = REVIEW_BOOK) -> Column:
    """Struct(primary_tag, secondary_tag, categories_mentioned, explored_new, sentiment)."""
    text = F.col(text) if isinstance(text, str) else text
    # Plain CASE chains and array concatenation, no lambdas: the whole struct
    # stays in generated code, where the lower-cased text is computed once per
    # row and shared by every substring test.
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = [(tag, _any_contains(low, words, book.whole_words)) for tag, words in book.rules]

    def first_of(cands, default=None):
        expr = None
        for tag, hit in cands:
            expr = F.when(hit, F.lit(tag)) if expr is None else expr.when(hit, F.lit(tag))
        if expr is None:
            return F.lit(default).cast("string")
        return expr.otherwise(F.lit(default).cast("string"))

    primary = first_of(hits, book.default_tag)
    secondary = None
    for i, (_, hit) in enumerate(hits):
        nxt = first_of(hits[i + 1:])
        secondary = F.when(hit, nxt) if secondary is None else secondary.when(hit, nxt)
    secondary = F.lit(None).cast("string") if secondary is None else secondary
    empty = F.array().cast("array<string>")
    cats = F.concat(*[F.when(_any_contains(low, [w], book.whole_words), F.array(F.lit(w))).otherwise(empty)
                      for w in book.categories]) if book.categories else empty
    pos = _any_contains(low, book.positive, book.whole_words)
    neg = _any_contains(low, book.negative, book.whole_words)
    sentiment = (F.when(pos & neg, F.lit("mixed")).when(pos, F.lit("positive"))
                 .when(neg, F.lit("negative")).otherwise(F.lit(book.default_sentiment)))
    return F.struct(
        primary.alias("primary_tag"),
        secondary.alias("secondary_tag"),
        cats.alias("categories_mentioned"),
        _any_contains(low, book.explored, book.whole_words).alias("explored_new"),
        sentiment.alias("sentiment"),
    )


class RuleTagger:
    """Batch tagger with the model's interface: rows in, reply text out.

    ``style`` shapes the reply like model output: ``plain`` JSON, a fenced
    block with a ``json`` tag (``fenced_json``) or without (``fenced``).
    """

    def __init__(self, book: RuleBook = REVIEW_BOOK, style: str = "plain"):
        self.book = book
        self.style = style

    def tag_one(self, rid: str, text: str | None) -> dict:
        low = (text or "").lower()

        def has(words: list[str]) -> bool:
            if self.book.whole_words:
                return bool(words) and re.search(_pattern(words), low) is not None
            return any(w in low for w in words)

        fired = [tag for tag, words in self.book.rules if has(words)]
        pos, neg = has(self.book.positive), has(self.book.negative)
        sentiment = ("mixed" if pos and neg else "positive" if pos else "negative" if neg
                     else self.book.default_sentiment)
        return {
            "id": rid,
            "primary_tag": fired[0] if fired else self.book.default_tag,
            "secondary_tag": fired[1] if len(fired) > 1 else None,
            "categories_mentioned": [w for w in self.book.categories if has([w])],
            "explored_new": has(self.book.explored),
            "sentiment": sentiment,
        }

    def __call__(self, rows: list[dict]) -> str:
        body = json.dumps([self.tag_one(r["id"], r["text"]) for r in rows], ensure_ascii=False)
        if self.style == "fenced_json":
            return "```json\n" + body + "\n```"
        if self.style == "fenced":
            return "```\n" + body + "\n```"
        return body
