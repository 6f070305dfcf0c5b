"""Rule book for the documents analogue.

The test documents are invented prose: none of the review words of the
default book occur in them, so every row would fall to the noise tag. This
book keys the same codebook tags on syllables that do occur in the invented
text, so the tagging job produces a spread of tags, categories and
sentiments to check. It is test configuration, like the analogue aliases.
"""

from __future__ import annotations

import json

from feedlens.operators.rules import RuleBook, RuleTagger

# Fixed analogue values (repeated by the oracle SQL through the same object).
ANALOG_BOOK = RuleBook(
    rules=[
        ("TRUST_QUALITY", ["eau"]),
        ("TRUST_AUTHENTICITY", ["sch"]),
        ("PRICE_VALUE", ["tion"]),
        ("MENTAL_MODEL", ["que"]),
        ("DISCOVERY_GAP", ["keit"]),
        ("INFO_GAP", ["ment"]),
        ("HABIT_AUTOPILOT", ["license"]),
    ],
    categories=["elle", "von", "los", "das", "mit", "pour", "thing", "ado"],
    explored=["sur "],
    positive=["the "],
    negative=["der "],
    whole_words=False,
)


class FaultyTagger:
    """A tagger that fails, babbles and drifts by fixed rules on the ids, which the SQL
    repeats: the batch's first id divisible by 11 raises, by 13 adds prose after the
    array; an id divisible by 17 gets a tag off the book, by 19 an unknown sentiment, by
    29 an unknown secondary tag, and by 23 comes back changed."""

    def __init__(self, book: RuleBook = ANALOG_BOOK):
        self.inner = RuleTagger(book)

    def __call__(self, rows: list[dict]) -> str:
        first = int(rows[0]["id"])
        if first % 11 == 0:
            raise RuntimeError("model unavailable")
        tags = [self.inner.tag_one(r["id"], r["text"]) for r in rows]
        for tag in tags:
            n = int(tag["id"])
            if n % 17 == 0:
                tag["primary_tag"] = "OFF_BOOK"
            if n % 19 == 0:
                tag["sentiment"] = "meh"
            if n % 29 == 0:
                tag["secondary_tag"] = "ODD"
            if n % 23 == 0:
                tag["id"] += "x"
        return json.dumps(tags) + (" These are the tags." if first % 13 == 0 else "")
