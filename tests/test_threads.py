"""Thread JSON walk (S4, S5, F2, P10, A12) on an invented F-D fixture."""

import datetime as dt
import json

from feedlens.sources import threads as thr


def node(cid, body, replies="", ups=None, kind="t1", created=1700000000):
    data = {"id": cid, "body": body, "created_utc": created, "replies": replies}
    if ups is not None:
        data["ups"] = ups
    return {"kind": kind, "data": data}


def listing(children):
    return {"kind": "Listing", "data": {"children": children}}


LONG = "this comment is long enough to keep"


def thread_doc(title, selftext, comments, ups=7):
    post = {"kind": "t3", "data": {"id": f"p_{title[:3]}", "title": title, "selftext": selftext,
                                    "ups": ups, "created_utc": 1700000000}}
    return json.dumps([listing([post]), listing(comments)])


def fixture(spark):
    deep = node("c3", LONG + " (depth 3)", "", ups=1)
    deleted = node("c2", "[deleted]", listing([deep]), ups=2)   # not emitted, still walked
    short = node("c5", "too short", listing([node("c6", LONG + " (under short)")]))
    more = {"kind": "more", "data": {"id": "m1", "children": ["x", "y"]}}
    top = node("c1", LONG, listing([deleted, more]), ups=None)  # missing ups -> 0
    t_a = thread_doc("Post title", "with self text", [top, short, node("c4", LONG + " 2nd")])
    t_b = thread_doc("x" * 19, "", [])   # 'x' * 19 + '. ' strips to 20 chars: dropped
    t_c = thread_doc("y" * 18, "z", [])  # 'y' * 18 + '. z' = 21 chars: kept
    t_bad = '[{"data": {"children": ['    # truncated JSON
    rows = [("https://f/comments/aaa/one/", t_a), ("https://f/comments/bbb/two/", t_b),
            ("https://f/comments/ccc/three/", t_c), ("https://f/comments/ddd/bad/", t_bad)]
    return thr.parse_threads(spark.createDataFrame(rows, "thread string, json string"))


def test_posts(spark):
    posts = {r.thread: r for r in thr.thread_posts(fixture(spark)).collect()}
    assert set(posts) == {"https://f/comments/aaa/one/", "https://f/comments/ccc/three/"}
    p = posts["https://f/comments/aaa/one/"]
    assert p.content == "Post title. with self text" and p.thumbsUpCount == 7
    assert p.at == dt.datetime(2023, 11, 14, 22, 13, 20)


def test_comments_walk_and_order(spark):
    rows = thr.thread_comments(fixture(spark)).orderBy("thread", "path").collect()
    assert [r.reviewId for r in rows] == ["c1", "c3", "c6", "c4"]
    by_id = {r.reviewId: r for r in rows}
    assert by_id["c1"].thumbsUpCount == 0 and by_id["c3"].depth == 3
    assert by_id["c6"].depth == 2


def test_more_nodes_are_seen_not_descended(spark):
    nodes = thr.comment_nodes(fixture(spark))
    kinds = sorted(r.kind for r in nodes.collect())
    assert kinds.count("more") == 1 and kinds.count("t1") == 6  # c1 c2 c3 c4 c5 c6


def test_land_threads_keeps_first_copy_in_thread_order(spark):
    same = "the same long comment posted in two threads"
    t1 = thread_doc("First thread title here", "", [node("x1", same), node("x2", LONG)])
    t2 = thread_doc("Second thread title here", "", [node("y1", same)])
    docs = spark.createDataFrame([("https://f/comments/b/2/", t2), ("https://f/comments/a/1/", t1)],
                                 "thread string, json string")
    rows = {r.reviewId: r for r in thr.land_threads(thr.parse_threads(docs)).collect()}
    assert "x1" in rows and "y1" not in rows        # thread .../a/1/ sorts first
    assert {"p_Fir", "p_Sec", "x2"} <= set(rows)


def test_thread_report(spark):
    rep = {r.thread: r for r in thr.thread_report(fixture(spark)).collect()}
    a = rep["https://f/comments/aaa/one/"]
    assert (a.ok, a.posts_kept, a.comments_kept, a.rows_kept) == (True, 1, 4, 5)
    assert rep["https://f/comments/bbb/two/"].rows_kept == 0
    assert rep["https://f/comments/ddd/bad/"].ok is False
