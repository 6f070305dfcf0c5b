"""Python-literal list parsing for legacy CSV exports.

The reference reads category lists with Python's literal evaluator. Two tiers
give exactly its results:

* Tier 1, in the JVM: a strict pattern accepts only a list or tuple of plain
  quoted strings (no backslash escapes, no line breaks inside an item, Python's
  rule that a one-item tuple needs a trailing comma), written with spaces or
  tabs between tokens. A prefix u or r changes nothing in a string without
  backslashes, so it may stand. For such text the items are the quoted contents, so
  they are extracted with a regular expression and never leave the JVM.
* Tier 2, a vectorised pandas UDF applying Python's literal evaluator, for
  every other non-null text (escapes, numbers, ``None`` items, strings,
  dicts, malformed text). It receives a null for every tier-1 row, so almost
  nothing crosses to Python in the common case.
"""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIST_OF_STRINGS = T.ArrayType(T.StringType())

# Tier-1 grammar (Java regex). Quantifiers are possessive (`*+`): an item's
# character class excludes its closing quote and a separator needs a following
# item, so giving characters back could never produce a match.
_SQ = r"'[^'\\\r\n]*+'"
_DQ = r'"[^"\\\r\n]*+"'
_PLAIN = rf"(?:{_SQ}|{_DQ})"
_ITEM = rf"(?:[uUrR]?+{_PLAIN})"
_WS = r"[ \t]*+"
_SEP = rf"{_WS},{_WS}"
_LIST = rf"\[{_WS}(?:{_ITEM}(?:{_SEP}{_ITEM})*+(?:{_WS},)?)?{_WS}\]"
_TUPLE = (rf"\({_WS}\)"                                             # ()
          rf"|\({_WS}{_ITEM}{_WS},{_WS}\)"                          # ('a',)
          rf"|\({_WS}{_ITEM}(?:{_SEP}{_ITEM})++(?:{_WS},)?{_WS}\)")  # ('a', 'b'[,])
SIMPLE_LITERAL = rf"\A{_WS}(?:{_LIST}|{_TUPLE}){_WS}\z"
ITEM_CAPTURE = rf"({_PLAIN})"


def _literal_items(s):
    """Items of a Python literal as text, or None when it is not iterable."""
    if s is None:
        return None
    try:
        value = ast.literal_eval(s)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None
    if not hasattr(value, "__iter__"):
        return None
    try:
        if isinstance(value, (set, frozenset)):  # Python's own order is arbitrary
            return sorted(str(item) for item in value)
        return [str(item) for item in value]  # a dict gives its keys, as in Python
    except TypeError:
        return None


@F.pandas_udf(LIST_OF_STRINGS)
def _literal_list_udf(s: pd.Series) -> pd.Series:
    with warnings.catch_warnings():  # e.g. invalid escapes such as '\d' in old exports
        warnings.simplefilter("ignore", SyntaxWarning)
        return s.map(lambda v: None if v is None or (isinstance(v, float) and pd.isna(v))
                     else _literal_items(v))


def parse_list(c: Column | str) -> Column:
    """Parse a list literal to ``array<string>``; null when it is not iterable."""
    c = F.col(c) if isinstance(c, str) else c
    simple = c.rlike(SIMPLE_LITERAL)
    quoted = F.regexp_extract_all(c, F.lit(ITEM_CAPTURE), F.lit(1))
    tier1 = F.transform(quoted, lambda q: F.substring(q, F.lit(2), F.length(q) - 2))
    tier2 = _literal_list_udf(F.when(c.isNotNull() & ~simple, c))
    return F.when(simple, tier1).otherwise(tier2)


def with_lists(df: DataFrame, col: str, out: str | None = None, strict: bool = True,
               seen: Observation | None = None) -> DataFrame:
    """``df`` with the list literals of ``col`` parsed into ``out`` (``col`` itself without it).

    The report's way (``strict``): text that is no list literal ends the job with an error that
    shows it; a null stays null. Otherwise such text gives null, as ``parse_list`` does, and
    ``seen`` counts it in the pass that uses the lists: ``lists``, ``bad_lists`` and
    ``bad_example``, the least bad text by its first 200 characters. (A sort after it would
    count twice, as Spark runs the rows before a range partitioning once more for its sample.)
    """
    text = F.col(f"`{col}`")
    rows = df.withColumn("_list", parse_list(text))
    bad = text.isNotNull() & F.col("_list").isNull()
    shown = F.substring(text, 1, 200)
    if seen is not None:
        rows = rows.observe(seen, F.count(text).alias("lists"), F.count_if(bad).alias("bad_lists"),
                            F.min(F.when(bad, shown)).alias("bad_example"))
    found = F.col("_list")
    if strict:
        found = F.when(bad, F.raise_error(F.concat(F.lit("not a list literal: "), shown)).cast(LIST_OF_STRINGS)) \
            .otherwise(found)
    return rows.withColumn(out or col, found).drop("_list")
