"""DuckDB SQL twins of the registered queries (the correctness oracle).

Tables region, nation, customer, supplier, part, orders, lineitem, events,
documents, embeddings, pages, benchmark, labels and conversations are views.
The analogue rules of ``plans/analogues.py`` are restated here in SQL, written
independently of the Spark code path (e.g. mentions come straight from
lineitem rather than from an exploded list).
"""

from __future__ import annotations

from feedlens.functions.text import PY_WHITESPACE
from feedlens.plans import analogues as an

ORACLE: dict[str, str] = {}

# Python's strip() set, as a DuckDB expression.
WS = "(" + "||".join(f"chr({ord(c)})" for c in PY_WHITESPACE) + ")"


def trim_u(x: str) -> str:
    return f"trim({x}, {WS})"


def _values(rows, cols, alias: str = "t") -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return str(v)
        return "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS {alias}({', '.join(cols)})"


def _case(col: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {whens} END"


def _case_num(col: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in mapping.items())
    return f"CASE {whens} END"


ALIAS_VALUES = _values(sorted(an.ANALOG_ALIASES.items()), ["raw", "canonical"], "a")
PERISHABLE_VALUES = _values([(c,) for c in an.ANALOG_PERISHABLE], ["category"])

# R3 analogue, one row per order line (the list column as its two items).
TAGGED_ROWS = f"""
tagged AS (
  SELECT CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) || '-'
           || CAST(l.l_partkey AS VARCHAR) || '-' || CAST(l.l_suppkey AS VARCHAR) AS reviewId,
         lower(c.c_mktsegment) AS source,
         {_case('o.o_orderpriority', an.PRIORITY_TAG)} AS primary_tag,
         {_case('o.o_orderstatus', an.STATUS_SECONDARY)} AS secondary_tag,
         (o.o_orderstatus = 'F') AS explored_new,
         {_case('o.o_orderstatus', an.STATUS_SENTIMENT)} AS sentiment,
         CAST(substr(o.o_orderpriority, 1, 1) AS DOUBLE) AS score,
         p.p_name,
         string_split(p.p_name, ' ')[-1] AS noun,
         'order ' || CAST(l.l_orderkey AS VARCHAR) || ' by ' || c.c_name || ': the '
           || p.p_name || ', a ' || string_split(p.p_name, ' ')[-1] AS content
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
                  JOIN orders o ON l.l_orderkey = o.o_orderkey
                  JOIN customer c ON o.o_custkey = c.c_custkey
)"""

# One row per mention: the part name (position 0) and its noun (position 1).
MENTIONS = """
mentions AS (
  SELECT reviewId, primary_tag, source, CAST(0 AS BIGINT) AS pos, p_name AS category_raw
  FROM tagged
  UNION ALL
  SELECT reviewId, primary_tag, source, CAST(1 AS BIGINT) AS pos, noun AS category_raw
  FROM tagged
)"""

NORMALIZED = f"""
normalized AS (
  SELECT m.*, coalesce(a.canonical, lower({trim_u('m.category_raw')})) AS category
  FROM mentions m LEFT JOIN {ALIAS_VALUES} ON lower({trim_u('m.category_raw')}) = a.raw
)"""


def _panel_sql(panel: str, tag: str, mode: str) -> str:
    member = f"category IN (SELECT category FROM {PERISHABLE_VALUES})"
    cond = member if mode == "perishable" else f"NOT ({member})"
    return f"""
  SELECT '{panel}' AS panel, '{tag}' AS primary_tag, category, mentions, reviews,
         CAST(row_number() OVER (ORDER BY mentions DESC, category ASC) AS BIGINT) AS rank
  FROM (SELECT category, CAST(count(*) AS BIGINT) AS mentions,
               CAST(count(DISTINCT reviewId) AS BIGINT) AS reviews
        FROM normalized WHERE primary_tag = '{tag}' AND category IS NOT NULL AND {cond}
        GROUP BY category
        ORDER BY mentions DESC, category ASC LIMIT 8)"""


ORACLE["category_top_k"] = (
    f"WITH {TAGGED_ROWS}, {MENTIONS}, {NORMALIZED}\n"
    + _panel_sql("freshness", "TRUST_QUALITY", "perishable")
    + "\nUNION ALL\n"
    + _panel_sql("authenticity", "TRUST_AUTHENTICITY", "nonperishable")
)

PERISHABLE_MEMBER = f"category IN (SELECT category FROM {PERISHABLE_VALUES})"

FEED = f"""
feed AS (
  SELECT e.event_id, e.ts, e.user_id, e.event_type,
         CAST({_case_num('e.event_type', an.EVENT_SCORE)} AS INTEGER) AS score,
         d.text AS content
  FROM events e JOIN documents d ON e.user_id = d.doc_id
)"""

SUBSTANTIVE = "({c} IS NOT NULL AND length({c}) > 20)"


def subst(c: str) -> str:
    return SUBSTANTIVE.format(c=c)


ORACLE["category_counts_raw"] = f"""
WITH {TAGGED_ROWS}, {MENTIONS}
SELECT primary_tag, category_raw AS category, CAST(count(*) AS BIGINT) AS mentions
FROM mentions
WHERE primary_tag IN ('TRUST_QUALITY', 'TRUST_AUTHENTICITY') AND category_raw IS NOT NULL
GROUP BY primary_tag, category_raw"""

ORACLE["shown_mentions"] = f"""
WITH {TAGGED_ROWS}, {MENTIONS}, {NORMALIZED},
panel_counts AS (
  SELECT 'freshness' AS panel, category, count(*) AS mentions FROM normalized
  WHERE primary_tag = 'TRUST_QUALITY' AND category IS NOT NULL AND {PERISHABLE_MEMBER}
  GROUP BY category
  UNION ALL
  SELECT 'authenticity' AS panel, category, count(*) AS mentions FROM normalized
  WHERE primary_tag = 'TRUST_AUTHENTICITY' AND category IS NOT NULL AND NOT ({PERISHABLE_MEMBER})
  GROUP BY category
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY panel ORDER BY mentions DESC, category ASC) AS rk
  FROM panel_counts
)
SELECT p.panel,
       CAST(coalesce(sum(CASE WHEN r.rk <= 8 THEN r.mentions END), 0) AS BIGINT) AS shown_mentions,
       CAST(coalesce(sum(r.mentions), 0) AS BIGINT) AS all_mentions
FROM (VALUES ('freshness'), ('authenticity')) AS p(panel)
LEFT JOIN ranked r ON r.panel = p.panel
GROUP BY p.panel"""

ORACLE["category_mentions"] = f"""
WITH {TAGGED_ROWS}, {MENTIONS}
SELECT reviewId, primary_tag, pos, category_raw FROM mentions"""

ORACLE["category_normalize"] = f"""
WITH {TAGGED_ROWS}, {MENTIONS}, {NORMALIZED}
SELECT reviewId, pos, category_raw, category FROM normalized"""

ORACLE["cats_perishable"] = f"""
WITH {TAGGED_ROWS}, {MENTIONS}, {NORMALIZED}
SELECT reviewId, primary_tag, pos, category FROM normalized WHERE {PERISHABLE_MEMBER}"""

ORACLE["cats_nonperishable"] = f"""
WITH {TAGGED_ROWS}, {MENTIONS}, {NORMALIZED}
SELECT reviewId, primary_tag, pos, category FROM normalized
WHERE category IS NULL OR NOT ({PERISHABLE_MEMBER})"""

ORACLE["tag_counts"] = f"""
WITH {TAGGED_ROWS}
SELECT primary_tag, CAST(count(*) AS BIGINT) AS reviews FROM tagged
WHERE primary_tag IS NOT NULL GROUP BY primary_tag"""

ORACLE["signal_tag_counts"] = f"""
WITH {TAGGED_ROWS}
SELECT primary_tag, CAST(count(*) AS BIGINT) AS reviews FROM tagged
WHERE primary_tag IS NOT NULL AND primary_tag IS DISTINCT FROM 'SERVICE_NOISE'
GROUP BY primary_tag"""

ORACLE["tag_by_source"] = f"""
WITH {TAGGED_ROWS}
SELECT primary_tag,
""" + ",\n".join(
    f"  CAST(count(*) FILTER (WHERE source = '{s}') AS BIGINT) AS {s}" for s in an.MARKET_SEGMENTS
) + """
FROM tagged WHERE primary_tag IS NOT NULL AND source IS NOT NULL GROUP BY primary_tag"""

ORACLE["noise_split"] = f"""
WITH {TAGGED_ROWS}
SELECT CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE primary_tag IS NOT DISTINCT FROM 'SERVICE_NOISE') AS BIGINT) AS noise,
       CAST(count(*) FILTER (WHERE primary_tag IS DISTINCT FROM 'SERVICE_NOISE') AS BIGINT) AS signal
FROM tagged"""

ORACLE["signal_share"] = f"""
WITH {TAGGED_ROWS},
c AS (SELECT primary_tag, CAST(count(*) AS BIGINT) AS reviews FROM tagged
      WHERE primary_tag IS NOT NULL AND primary_tag IS DISTINCT FROM 'SERVICE_NOISE'
      GROUP BY primary_tag)
SELECT primary_tag, reviews,
       CAST(reviews AS DOUBLE) / CAST(sum(reviews) OVER () AS DOUBLE) AS share
FROM c"""

ORACLE["source_share_of_tag"] = f"""
WITH {TAGGED_ROWS},
c AS (SELECT primary_tag, source, CAST(count(*) AS BIGINT) AS reviews FROM tagged
      WHERE primary_tag IS NOT NULL AND source IS NOT NULL GROUP BY primary_tag, source)
SELECT primary_tag, source, reviews,
       CAST(reviews AS DOUBLE) / CAST(sum(reviews) OVER (PARTITION BY primary_tag) AS DOUBLE)
         AS share_of_tag,
       CAST(sum(reviews) OVER (PARTITION BY source) AS DOUBLE)
         / CAST(sum(reviews) OVER () AS DOUBLE) AS share_of_corpus
FROM c"""

ORACLE["corpus_size"] = f"""
WITH {TAGGED_ROWS}
SELECT source, CAST(count(*) AS BIGINT) AS reviews FROM tagged GROUP BY source"""

ORACLE["signal_rows"] = f"""
WITH {TAGGED_ROWS}
SELECT reviewId, primary_tag, source FROM tagged
WHERE primary_tag IS DISTINCT FROM 'SERVICE_NOISE'"""

ORACLE["gold_rows"] = f"""
WITH {TAGGED_ROWS}
SELECT reviewId, source, primary_tag, content
FROM tagged WHERE explored_new"""

ORACLE["substantive"] = f"""
SELECT CAST(doc_id AS VARCHAR) AS reviewId, source FROM documents WHERE {subst('text')}"""

ORACLE["substantive_yield"] = f"""
SELECT source AS app, CAST(count(*) AS BIGINT) AS pulled,
       CAST(count(*) FILTER (WHERE {subst('text')}) AS BIGINT) AS substantive
FROM documents GROUP BY source"""

ORACLE["land_play"] = f"""
WITH {FEED}
SELECT CAST(event_id AS VARCHAR) AS reviewId, CAST(score AS DOUBLE) AS score,
       CAST(user_id AS DOUBLE) AS thumbsUpCount, 'play_store' AS source,
       content
FROM feed WHERE {subst('content')}"""

ORACLE["land_appstore"] = f"""
WITH {FEED}
SELECT 'ios_' || CAST(event_id AS VARCHAR) AS reviewId, CAST(score AS DOUBLE) AS score,
       CAST(NULL AS DOUBLE) AS thumbsUpCount, 'app_store' AS source,
       content
FROM feed WHERE {subst('content')}"""

ORACLE["score_distribution"] = f"""
WITH {FEED}
SELECT CAST(score AS DOUBLE) AS score, CAST(count(*) AS BIGINT) AS reviews
FROM feed WHERE {subst('content')} AND score IS NOT NULL GROUP BY score"""

ORACLE["newest_reviews"] = f"""
WITH {FEED},
top AS (SELECT * FROM feed ORDER BY ts DESC NULLS LAST, CAST(event_id AS VARCHAR) ASC LIMIT 60)
SELECT CAST(event_id AS VARCHAR) AS reviewId, score,
       content
FROM top WHERE {subst('content')}"""

ORACLE["ingest_column"] = f"""
WITH idx AS (SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS idx,
                    coalesce(text, 'nan') AS content FROM documents)
SELECT 'up_' || CAST(idx AS VARCHAR) AS reviewId, idx,
       content
FROM idx WHERE {subst('content')}"""

ORACLE["ingest_lines"] = f"""
WITH kept AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {trim_u('x')}),
                             lambda x: length(x) > 20) AS lines
  FROM documents
), lines AS (
  SELECT doc_id, unnest(lines) AS content, unnest(generate_series(0, len(lines) - 1)) AS line_no
  FROM kept
)
SELECT doc_id, 'own_' || CAST(line_no AS VARCHAR) AS reviewId, CAST(line_no AS BIGINT) AS line_no,
       content
FROM lines"""

ORACLE["union_sources"] = f"""
WITH {FEED}
SELECT CAST(event_id AS VARCHAR) AS reviewId, CAST(score AS DOUBLE) AS score,
       CAST(user_id AS DOUBLE) AS thumbsUpCount, 'play_store' AS source,
       CAST(NULL AS VARCHAR) AS thread, content
FROM feed WHERE {subst('content')}
UNION ALL
SELECT CAST(doc_id AS VARCHAR), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), source,
       CAST(NULL AS VARCHAR), text
FROM documents WHERE {subst('text')}"""

ORACLE["land_together"] = f"""
WITH {FEED}
SELECT CAST(event_id AS VARCHAR) AS reviewId, 'play_store' AS source, content,
       CAST(event_id AS BIGINT) AS seq
FROM feed WHERE {subst('content')} AND score >= 3
UNION ALL
SELECT CAST(doc_id AS VARCHAR), source, text, CAST(doc_id AS BIGINT)
FROM documents WHERE {subst('text')}"""

# The test table is written in doc_id order.
ORACLE["file_order"] = ORACLE["ingest_column"]

ORACLE["pull_pages"] = f"""
WITH {FEED},
placed AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS place FROM feed),
pages AS (SELECT place // 200 AS page, count(*) AS n FROM placed GROUP BY page),
totals AS (SELECT page, sum(n) OVER (ORDER BY page) AS total FROM pages),
last AS (SELECT min(page) AS page FROM totals WHERE total >= 3000)
SELECT CAST(event_id AS VARCHAR) AS reviewId, CAST(score AS DOUBLE) AS score, 'play_store' AS source, content
FROM placed, last
WHERE {subst('content')} AND (last.page IS NULL OR place // 200 <= last.page)"""

ORACLE["pull_by_page"] = f"""
WITH {FEED},
pages AS (SELECT user_id AS page, count(*) AS n FROM feed GROUP BY user_id),
totals AS (SELECT page, n, sum(n) OVER (ORDER BY page) AS total,
                  row_number() OVER (ORDER BY page) - 1 AS nth FROM pages),
stop AS (SELECT least(min(CASE WHEN total >= 3000 THEN page + 1 END),
                      min(CASE WHEN nth < page THEN nth END)) AS at FROM totals)
SELECT CAST(page AS BIGINT) AS page, CAST(n AS BIGINT) AS rows
FROM totals, stop WHERE stop.at IS NULL OR page < stop.at"""

ORACLE["first_n"] = """
SELECT CAST(doc_id AS VARCHAR) AS reviewId, source FROM documents ORDER BY doc_id LIMIT 100"""

ORACLE["dedup_content"] = """
SELECT reviewId, source, content FROM (
  SELECT CAST(doc_id AS VARCHAR) AS reviewId, source, text AS content,
         row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn
  FROM documents) WHERE rn = 1"""

# --- page dumps and threads -----------------------------------------------------
DUMPS = """
dumps AS (
  SELECT 'thread' || CAST(conv_id AS VARCHAR) || '.txt' AS file,
         string_agg(text || chr(10) || chr(10), '' ORDER BY turn) AS value
  FROM conversations GROUP BY conv_id
)"""

CHUNKS = f"""
parts AS (SELECT file, string_split(value, chr(10) || chr(10)) AS p FROM dumps),
chunks AS (
  SELECT file, CAST(i - 1 AS BIGINT) AS idx, file || '_' || CAST(i - 1 AS VARCHAR) AS reviewId,
         {trim_u('p[i]')} AS content
  FROM parts, range(1, len(p) + 1) AS r(i)
)"""

DEBRIS_WORDS = ["reply", "share", "report", "upvote", "downvote",
                "· ", "ago", "points", "sort by", "view more"]
DEBRIS = "(" + " OR ".join(f"contains(lower(content), '{w}')" for w in DEBRIS_WORDS) + \
    ") AND length(content) < 60"
CLEAN = f"""
clean AS (SELECT * FROM chunks WHERE length(content) >= 25 AND NOT ({DEBRIS}))"""

ORACLE["src_dumps"] = f"""
WITH {DUMPS}
SELECT file, value FROM dumps"""

ORACLE["chunk_text"] = f"""
WITH {DUMPS}, {CHUNKS}
SELECT file, idx, reviewId, content FROM chunks"""

ORACLE["chunk_large"] = f"""
WITH dumps AS (
  SELECT 'dump' || CAST(conv_id % 4 AS VARCHAR) || '.txt' AS file,
         string_agg(text || chr(10) || chr(10), '' ORDER BY conv_id, turn) AS value
  FROM conversations GROUP BY conv_id % 4
), {CHUNKS}
SELECT file, idx, reviewId, content FROM chunks WHERE content <> ''"""

ORACLE["chunk_clean"] = f"""
WITH {DUMPS}, {CHUNKS}, {CLEAN}
SELECT file, idx, reviewId, content FROM clean"""

ORACLE["dump_reviews"] = f"""
WITH {DUMPS}, {CHUNKS}, {CLEAN},
ranked AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY file, idx) AS rn FROM clean)
SELECT reviewId, file AS thread, idx, 'reddit_manual' AS source, content FROM ranked WHERE rn = 1"""

THREAD_URL = (f"'{an.THREAD_URL}' || CAST(conv_id AS VARCHAR) || '/conversation_' "
              f"|| CAST(conv_id AS VARCHAR) || '/'")
EPOCH_TS = (f"(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(CAST({an.THREAD_EPOCH} "
            "+ conv_id * 3600 + turn * 60 AS DOUBLE)))")

ORACLE["thread_posts"] = f"""
SELECT 'p' || CAST(conv_id AS VARCHAR) AS reviewId,
       {trim_u("'thread ' || CAST(conv_id AS VARCHAR) || '. ' || coalesce(text, '')")} AS content,
       CAST(conv_id AS BIGINT) AS thumbsUpCount, {EPOCH_TS} AS at, {THREAD_URL} AS thread
FROM conversations
WHERE turn = 0
  AND length({trim_u("'thread ' || CAST(conv_id AS VARCHAR) || '. ' || coalesce(text, '')")}) > 20"""

COMMENTS = """
comments AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS depth
  FROM conversations WHERE turn > 0
)"""

ORACLE["thread_comments"] = f"""
WITH {COMMENTS}
SELECT 'c' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS reviewId,
       CAST(CASE WHEN role <> 'system' THEN turn ELSE 0 END AS BIGINT) AS thumbsUpCount,
       {EPOCH_TS} AS at, {THREAD_URL} AS thread, depth,
       text AS content
FROM comments
WHERE {subst('text')} AND text NOT IN ('[deleted]', '[removed]')"""

ORACLE["thread_report"] = f"""
SELECT {THREAD_URL} AS thread, TRUE AS ok,
       CAST(count(*) FILTER (WHERE turn = 0) AS BIGINT) AS posts_kept,
       CAST(count(*) FILTER (WHERE turn > 0 AND {subst('text')}
                                  AND text NOT IN ('[deleted]', '[removed]')) AS BIGINT)
         AS comments_kept,
       CAST(count(*) FILTER (WHERE turn = 0) + count(*) FILTER (
            WHERE turn > 0 AND {subst('text')} AND text NOT IN ('[deleted]', '[removed]'))
            AS BIGINT) AS rows_kept,
       CAST(sum(count(*) FILTER (WHERE turn = 0) + count(*) FILTER (
            WHERE turn > 0 AND {subst('text')} AND text NOT IN ('[deleted]', '[removed]')))
            OVER (ORDER BY {THREAD_URL}) AS BIGINT) AS rows_total
FROM conversations GROUP BY conv_id"""

ORACLE["thread_slug"] = f"""
SELECT {THREAD_URL} AS thread,
       substr(split_part({THREAD_URL}, '/comments/', 2), 1, 45) AS slug
FROM (SELECT DISTINCT conv_id FROM conversations)"""

ORACLE["thread_reviews"] = f"""
WITH rows AS (
  SELECT 'p' || CAST(conv_id AS VARCHAR) AS reviewId, {THREAD_URL} AS thread, turn,
         {trim_u("'thread ' || CAST(conv_id AS VARCHAR) || '. ' || coalesce(text, '')")} AS content
  FROM conversations WHERE turn = 0
  UNION ALL
  SELECT 'c' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR), {THREAD_URL}, turn, text
  FROM conversations WHERE turn > 0
),
kept AS (SELECT * FROM rows WHERE {subst('content')} AND content NOT IN ('[deleted]', '[removed]')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY thread, turn) AS rn FROM kept)
SELECT reviewId, thread, content FROM ranked WHERE rn = 1"""
