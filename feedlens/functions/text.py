"""Column-level text helpers (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlens import codebook as cb

# Fixed value: the 29 code points Python's str.strip() removes (str.isspace()).
PY_WHITESPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u001c\u001d\u001e\u001f\u0020"
    "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
FENCE = "```"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_u(c: Column | str) -> Column:
    """Strip leading/trailing Unicode whitespace exactly as Python's strip()."""
    return F.btrim(_c(c), F.lit(PY_WHITESPACE))


def preview(c: Column | str, n: int | None) -> Column:
    """First ``n`` code points (Python ``s[:n]``); the whole text when ``n`` is None."""
    return _c(c) if n is None else F.substring(_c(c), 1, n)


def substantive(c: Column | str, min_len: int = cb.MIN_CONTENT_CHARS) -> Column:
    """Not null and strictly longer than ``min_len`` code points."""
    c = _c(c)
    return c.isNotNull() & (F.length(c) > F.lit(min_len))


def not_deleted(c: Column | str) -> Column:
    """Not null, not empty and not the mark of a removed comment (F2)."""
    c = _c(c)
    return c.isNotNull() & (c != F.lit("")) & ~c.isin("[deleted]", "[removed]")


def normalize_label(c: Column | str) -> Column:
    """Human tag clean-up: strip, upper case."""
    return F.upper(trim_u(c))


def normalize_category_key(c: Column | str) -> Column:
    """Category lookup key: str(item).strip().lower() (P2 without the alias)."""
    return F.lower(trim_u(_c(c).cast("string")))


def is_ui_debris(c: Column | str, words: list[str] | None = None,
                 max_chars: int = cb.DEBRIS_MAX_CHARS) -> Column:
    """Short chunk containing any UI word as a plain substring of its lower case."""
    c = _c(c)
    words = cb.UI_DEBRIS_WORDS if words is None else words
    low = F.lower(c)
    hit = F.lit(False)
    for w in words:
        hit = hit | low.contains(w)
    return hit & (F.length(c) < F.lit(max_chars))


def strip_fence(c: Column | str) -> Column:
    """Model reply clean-up.

    Trim; when the reply starts with a code fence take the text between the
    first two fences and drop a leading ``json`` language tag, then trim again.
    The tag is only removed at the start, so replies that mention "json"
    elsewhere are left intact.
    """
    t = trim_u(c)
    inner = F.try_element_at(F.split(t, FENCE, -1), F.lit(2))
    inner = trim_u(F.regexp_replace(inner, r"^\s*json", ""))
    return F.when(t.startswith(FENCE), inner).otherwise(t)


def thread_slug(url: Column | str, n: int = 45) -> Column:
    """Text after ``/comments/``, first ``n`` code points; null when absent."""
    after = F.try_element_at(F.split(_c(url), "/comments/", -1), F.lit(2))
    return F.substring(after, 1, n)
