"""Forum thread documents (R6) to review rows.

A thread document is a two-element array: the post listing and the comment
listing. Comments nest through ``data.replies``, which is either a listing of
the same shape or an empty string. ``parse_threads`` flattens every document once,
in one walk of linear cost that no nesting depth stops, into the nodes that
posts, comments and the report read: nothing below parses a document again.
A document is one task's row; threads are spread over tasks. The ``path`` of
sibling positions orders rows depth-first, as the reference's recursive walk
emits them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens import codebook as cb
from feedlens.functions.text import not_deleted, substantive, trim_u
from feedlens.operators.ordering import dedup_keep_first, running_total

NODES = ("thread string, ok boolean, role string, kind string, path array<int>, depth long, "
         "id string, title string, body string, ups long, created double")


def epoch_to_ts(c: F.Column) -> F.Column:
    """Epoch seconds to a time-zone-free timestamp (P10)."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + \
        F.make_dt_interval(secs=c.cast("double").cast("decimal(18,6)"))


_TOKEN = re.compile(r'[\s,:]*(?:("(?:[^"\\]|\\.)*")|([\[{])|([\]}])|([^\s,:\[\]{}"]+))')


def load_json(text: str):
    """A JSON document of any nesting depth; ValueError if it is none. The standard
    parser recurses, so documents too deep for it are read with a stack of open values."""
    try:
        return json.loads(text)
    except RecursionError:
        pass
    root: list = []
    stack: list = [root]
    keys: list = [None]

    def put(value) -> None:
        if isinstance(stack[-1], list):
            stack[-1].append(value)
        elif keys[-1] is None:
            if not isinstance(value, str):
                raise ValueError("a key is not a string")
            keys[-1] = value
        else:
            stack[-1][keys[-1]], keys[-1] = value, None

    at, end = 0, len(text.rstrip())
    while at < end:
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"not JSON at {at}")
        string, opening, closing, plain = m.groups()
        if opening:
            value = [] if opening == "[" else {}
            put(value)
            stack.append(value)
            keys.append(None)
        elif closing:
            if len(stack) == 1 or isinstance(stack[-1], list) != (closing == "]"):
                raise ValueError(f"brackets do not match at {at}")
            stack.pop()
            keys.pop()
        else:
            put(json.loads(string or plain))
        at = m.end()
    if len(stack) != 1 or len(root) != 1:
        raise ValueError("not one JSON value")
    return root[0]


def _get(value, *steps):
    """The value below ``value`` along keys and positions, or None."""
    for step in steps:
        if isinstance(step, str):
            value = value.get(step) if isinstance(value, dict) else None
        else:
            value = value[step] if isinstance(value, list) and len(value) > step else None
    return value


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value)


def _number(value) -> float | None:
    try:
        return None if value is None else float(value)
    except (TypeError, ValueError):
        return None


def _nodes(thread: str, text: str | None) -> Iterator[tuple]:
    """The rows of one document: one for the thread, one for its post, one per comment node."""
    try:
        doc = load_json(text) if text is not None else None
    except ValueError:
        doc = None
    yield (thread, doc is not None, "thread", None, [], 0, None, None, None, None, None)

    def row(role: str, kind, path: list[int], data, body: str) -> tuple:
        ups = _number(_get(data, "ups"))
        return (thread, True, role, _text(kind), path, len(path), _text(_get(data, "id")), _text(_get(data, "title")),
                _text(_get(data, body)), None if ups is None else int(ups), _number(_get(data, "created_utc")))

    post = _get(doc, 0, "data", "children", 0, "data")
    if post is not None:
        yield row("post", "t3", [], post, "selftext")
    top = _get(doc, 1, "data", "children")
    stack = [(iter(enumerate(top)), [])] if isinstance(top, list) else []
    while stack:
        siblings, above = stack[-1]
        place, node = next(siblings, (None, None))
        if place is None:
            stack.pop()
            continue
        path = [*above, place]
        kind, data = _get(node, "kind"), _get(node, "data")
        yield row("comment", kind, path, data, "body")
        replies = _get(data, "replies", "data", "children")
        if kind == "t1" and isinstance(replies, list):
            stack.append((iter(enumerate(replies)), path))


def parse_threads(docs: DataFrame, thread_col: str = "thread", json_col: str = "json",
                  rows_out: int = 2_000) -> DataFrame:
    """The nodes of every thread document (see ``NODES``). Every thread has a row of role
    ``thread``, whose ``ok`` is false when the document does not parse."""
    names = [c.split()[0] for c in NODES.split(", ")]

    def run(frames):
        held: list[tuple] = []
        for f in frames:
            for thread, text in zip(f["thread"], f["json"]):
                for row in _nodes(thread, text):
                    held.append(row)
                    if len(held) >= rows_out or row[5] * len(held) > 4_000_000:
                        yield pd.DataFrame(held, columns=names)
                        held.clear()
        if held:
            yield pd.DataFrame(held, columns=names)

    return docs.select(F.col(thread_col).cast("string").alias("thread"), F.col(json_col).cast("string").alias("json")) \
        .mapInPandas(run, NODES)


def thread_posts(parsed: DataFrame, min_len: int = cb.MIN_CONTENT_CHARS) -> DataFrame:
    """The post of each thread (S4): ``strip(title + '. ' + selftext)``, kept
    when longer than ``min_len``; missing likes read as 0."""
    content = trim_u(F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("body", F.lit(""))))
    rows = parsed.filter(F.col("role") == "post").select(
        F.col("id").alias("reviewId"),
        content.alias("content"),
        F.lit(None).cast("double").alias("score"),
        F.coalesce("ups", F.lit(0)).cast("long").alias("thumbsUpCount"),
        epoch_to_ts(F.col("created")).alias("at"),
        F.lit("reddit").alias("source"),
        F.col("thread"),
    )
    return rows.filter(substantive("content", min_len))


def comment_nodes(parsed: DataFrame) -> DataFrame:
    """Every node of every comment tree.

    Only ``t1`` nodes are descended, as in the reference; other kinds (e.g.
    ``more``) appear once and stop there.
    """
    return parsed.filter(F.col("role") == "comment")


def thread_comments(parsed: DataFrame, min_len: int = cb.MIN_CONTENT_CHARS) -> DataFrame:
    """Comments and replies at any depth.

    A ``t1`` comment is emitted when its body is longer than ``min_len`` and is
    not ``[deleted]`` / ``[removed]``; short or deleted comments are not
    emitted but their replies still are. Likes default to 0.
    """
    rows = comment_nodes(parsed).filter(F.col("kind") == "t1").select(
        F.col("id").alias("reviewId"),
        F.col("body").alias("content"),
        F.lit(None).cast("double").alias("score"),
        F.coalesce("ups", F.lit(0)).cast("long").alias("thumbsUpCount"),
        epoch_to_ts(F.col("created")).alias("at"),
        F.lit("reddit").alias("source"),
        F.col("thread"),
        F.col("path"),
        F.col("depth"),
    )
    return rows.filter(substantive("content", min_len) & not_deleted("content"))


def land_threads(parsed: DataFrame, min_len: int = cb.MIN_CONTENT_CHARS) -> DataFrame:
    """Posts and comments of all threads as R1 rows, each text kept once.

    Input order is thread, then the post, then comments depth-first; the first
    copy of a text in that order is kept, as the reference's forum job does.
    """
    empty_path = F.array().cast("array<int>")
    posts = thread_posts(parsed, min_len).withColumn("_rank", F.lit(0)) \
        .withColumn("path", empty_path)
    comments = thread_comments(parsed, min_len).drop("depth").withColumn("_rank", F.lit(1))
    rows = posts.unionByName(comments)
    first = dedup_keep_first(rows, "content", ("thread", "_rank", "path"))
    return first.drop("_rank")


def thread_report(parsed: DataFrame, min_len: int = cb.MIN_CONTENT_CHARS) -> DataFrame:
    """Per thread: did it parse, posts kept, comments kept, rows kept (A12), in one
    aggregate over the nodes, and ``rows_total``, the rows kept so far in the order of the
    threads' names.

    Counts are exact: a post that is too short adds nothing (the reference
    adds one regardless).
    """
    content = trim_u(F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("body", F.lit(""))))
    nodes = parsed.withColumn("content", F.when(F.col("role") == "post", content).otherwise(F.col("body")))
    long = F.coalesce(substantive("content", min_len), F.lit(False))
    post = (F.col("role") == "post") & long
    comment = (F.col("role") == "comment") & (F.col("kind") == "t1") & long & not_deleted("content")
    report = nodes.groupBy("thread").agg(
        F.bool_and("ok").alias("ok"),
        F.count_if(post).cast("long").alias("posts_kept"),
        F.count_if(comment).cast("long").alias("comments_kept"),
        F.count_if(post | comment).cast("long").alias("rows_kept"))
    return running_total(report, "thread", "rows_kept", "rows_total")
