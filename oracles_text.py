"""DuckDB oracles for feedback, text and similarity queries."""

from __future__ import annotations

from halyard.functions import text as tx
from oracles import EV, FB, _w, lexicon_array_sql, stop_words_sql

TOKEN_RE = r"[\p{L}\p{N}_]{2,}"


def _ws_tokens(col: str) -> str:
    return (f"list_distinct(list_filter(string_split_regex(lower(coalesce({col}, '')), '\\s+'), "
            f"lambda t: t <> ''))")


def _lexicon(col: str, pos, neg) -> str:
    toks = _ws_tokens(col)
    npos = f"len(list_intersect({toks}, {lexicon_array_sql(pos)}))"
    nneg = f"len(list_intersect({toks}, {lexicon_array_sql(neg)}))"
    return f"""
SELECT doc_id,
  CASE WHEN npos > nneg THEN 'positive' WHEN nneg > npos THEN 'negative' ELSE 'neutral' END AS label,
  CASE WHEN npos <> nneg THEN 0.7 ELSE 0.5 END::DOUBLE AS score,
  CAST(npos AS INTEGER) AS n_pos, CAST(nneg AS INTEGER) AS n_neg
FROM (SELECT doc_id, {npos} AS npos, {nneg} AS nneg FROM documents)"""


def _terms_cte(src: str, id_col: str, text_col: str, name: str) -> str:
    return f""",
{name}_tok AS (
  SELECT {id_col} AS id, list_filter(regexp_extract_all(lower(coalesce({text_col}, '')), '{TOKEN_RE}'),
    lambda t: NOT list_contains({stop_words_sql()}, t)) AS t
  FROM {src}
),
{name}_terms AS (
  SELECT id, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM {name}_tok
),
{name} AS (SELECT id, term, count(*) AS tf FROM {name}_terms GROUP BY 1, 2)"""


INDEX = "q0 AS (SELECT 1)" + _terms_cte("documents", "doc_id", "text", "dtf") + """,
st AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM dtf GROUP BY 1),
vocab AS (
  SELECT term, df, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1.0 AS idf
  FROM st
),
dw AS (SELECT d.id AS doc_id, d.term, d.tf * v.idf AS w FROM dtf d JOIN vocab v ON d.term = v.term),
post AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM dw)"""

TFIDF_SEARCH = INDEX + """,
bq AS (SELECT item_id AS query_id, text AS query FROM benchmark)""" + _terms_cte("bq", "query_id", "query", "qtf") + """,
qw0 AS (SELECT q.id AS query_id, q.term, q.tf * v.idf AS w FROM qtf q JOIN vocab v ON q.term = v.term),
qw AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS wq FROM qw0),
sc AS (
  SELECT qw.query_id, p.doc_id, sum(qw.wq * p.weight) AS s FROM qw JOIN post p ON qw.term = p.term
  GROUP BY 1, 2 HAVING sum(qw.wq * p.weight) > 1e-12
),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM sc)"""


def _dot(a: str, b: str) -> str:
    return f"list_reduce(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]), lambda x, y: x + y)"


VECTOR = """
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ex AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e),
cent AS (
  SELECT label AS query_id, list(x ORDER BY pos) AS q
  FROM (SELECT label, pos, avg(x) AS x FROM ex GROUP BY 1, 2) GROUP BY 1
),
en AS (SELECT *, sqrt(""" + _dot("v", "v") + """) AS n FROM e),
qn AS (SELECT *, sqrt(""" + _dot("q", "q") + """) AS qn FROM cent),
sc AS (
  SELECT qn.query_id, en.vec_id, en.label, """ + _dot("en.v", "qn.q") + """ / (en.n * qn.qn) AS s
  FROM en, qn WHERE en.n > 0 AND qn.qn > 0
),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM sc)"""

TL = """,
tl0 AS (
  SELECT CAST(date_trunc('{unit}', created_at) AS DATE) AS period,
    avg(CAST(sentiment_label = 'positive' AS DOUBLE)) * 100 AS positive_pct,
    avg(CAST(sentiment_label = 'negative' AS DOUBLE)) * 100 AS negative_pct,
    avg(CAST(sentiment_label = 'neutral' AS DOUBLE)) * 100 AS neutral_pct,
    avg(sentiment_score) AS avg_score, count(*) AS total_count
  FROM {src} GROUP BY 1
),
tl AS (
  SELECT *, positive_pct - negative_pct AS net_sentiment,
    avg(positive_pct - negative_pct) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS trend
  FROM tl0
)"""

TL_SELECT = """
SELECT period, round(positive_pct, 6) AS positive_pct, round(negative_pct, 6) AS negative_pct,
  round(neutral_pct, 6) AS neutral_pct, round(avg_score, 6) AS avg_score, total_count,
  round(net_sentiment, 6) AS net_sentiment, round(trend, 6) AS trend FROM tl"""

STATS = """,
x AS (
  SELECT net_sentiment, row_number() OVER (ORDER BY period) AS a, row_number() OVER (ORDER BY period DESC) AS d,
    count(*) OVER () AS n FROM tl
),
g AS (
  SELECT max(n) AS n_periods, avg(net_sentiment) FILTER (WHERE d <= 4) AS recent_avg,
    avg(net_sentiment) FILTER (WHERE a <= greatest(1, n - 4)) AS older_avg FROM x
),
t AS (SELECT *, CASE WHEN n_periods < 2 THEN NULL WHEN recent_avg - older_avg > 5 THEN 'improving'
  WHEN recent_avg - older_avg < -5 THEN 'worsening' ELSE 'stable' END AS direction FROM g)
SELECT 'total_feedback' AS section, 'total' AS key, CAST(count(*) AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS text FROM fb
UNION ALL SELECT 'avg_sentiment_score', 'mean', round(avg(sentiment_score), 4), NULL FROM fb
UNION ALL SELECT 'index_stats', 'n_documents', CAST(count(*) AS DOUBLE), 'spark-exact-cosine' FROM fb
UNION ALL SELECT 'sentiment_distribution', sentiment_label, round(count(*) * 100.0 / sum(count(*)) OVER (), 1), NULL FROM fb GROUP BY 2
UNION ALL SELECT 'category_distribution', category, CAST(count(*) AS DOUBLE), NULL FROM fb WHERE category IS NOT NULL GROUP BY 2
UNION ALL SELECT 'channel_distribution', channel, CAST(count(*) AS DOUBLE), NULL FROM fb WHERE channel IS NOT NULL GROUP BY 2
UNION ALL SELECT 'trend', 'magnitude', round(abs(recent_avg - older_avg), 1), direction FROM t
UNION ALL SELECT 'trend', 'recent_avg', round(recent_avg, 1), direction FROM t
UNION ALL SELECT 'trend', 'older_avg', round(older_avg, 1), direction FROM t"""

TEXT_SQL = {
    "b27_sentiment_from_score": _w(FB, "SELECT feedback_id, sentiment_score, sentiment_label FROM fb"),
    "b28_filter_feedback": _w(FB, """
SELECT feedback_id, category, channel, sentiment_label FROM fb WHERE sentiment_label = 'negative' AND category = 'en'"""),
    "b29_substring_search": """
SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM (
  SELECT b.item_id AS query_id, d.doc_id, row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) AS rank
  FROM benchmark b JOIN documents d ON contains(lower(coalesce(d.text, '')), lower(b.text))
  WHERE length(lower(b.text)) > 0
) WHERE rank <= 5""",
    "d20_sentiment_distribution": _w(FB, """
SELECT sentiment_label, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct
FROM fb GROUP BY 1"""),
    "d21_sentiment_by_segment": _w(FB, """
SELECT category, sentiment_label AS sentiment,
  round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY category), 1) AS percentage FROM fb GROUP BY 1, 2"""),
    "d21b_sentiment_by_channel": _w(FB, """
SELECT channel, sentiment_label AS sentiment,
  round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY channel), 1) AS percentage FROM fb GROUP BY 1, 2"""),
    "d22_feedback_counts": _w(FB, """
SELECT 'category' AS dimension, category AS value, count(*) AS count FROM fb GROUP BY 2
UNION ALL SELECT 'channel', channel, count(*) FROM fb GROUP BY 2"""),
    "d24_recent_negative_pct": _w(FB, """
SELECT count(*) AS n_recent, round(avg(CAST(sentiment_label = 'negative' AS DOUBLE)) * 100, 1) AS negative_pct
FROM fb WHERE created_at >= (SELECT max(created_at) FROM fb) - INTERVAL 30 DAY"""),
    "d25_sentiment_timeline": _w(FB + TL.format(unit="week", src="fb"), TL_SELECT),
    "d25b_sentiment_timeline_monthly": _w(FB + TL.format(unit="month", src="fb"), TL_SELECT),
    "e01_rolling_mean": _w(EV + ",\nevc AS (SELECT *, ts AS created_at FROM ev)" + TL.format(unit="day", src="evc"), """
SELECT period, round(net_sentiment, 6) AS net_sentiment, round(trend, 6) AS trend, total_count FROM tl"""),
    "a05_parquet_artifacts": _w(FB + TL.format(unit="week", src="fb"), TL_SELECT),
    "k02_stream_sentiment_timeline": _w(EV + ",\nevc AS (SELECT *, ts AS created_at FROM ev)" + TL.format(unit="day", src="evc"), TL_SELECT),
    "d23_nlp_stats": _w(FB + TL.format(unit="week", src="fb"), STATS),
    "a06_json_artifacts": _w(FB + TL.format(unit="week", src="fb"), STATS),
    "h02_to_metadata_map": _w(FB, """
SELECT feedback_id, unnest(['category', 'channel', 'sentiment_label', 'created_at', 'sentiment_score']) AS key,
  unnest([coalesce(category, ''), coalesce(channel, ''), sentiment_label, CAST(created_at AS VARCHAR), CAST(sentiment_score AS VARCHAR)]) AS value FROM fb"""),
    "b07b_label_codes": _w(FB + """,
coded AS (SELECT *, dense_rank() OVER (ORDER BY category NULLS LAST) - 1 AS c, dense_rank() OVER (ORDER BY channel NULLS LAST) - 1 AS h,
  dense_rank() OVER (ORDER BY sentiment_label) - 1 AS s FROM fb)""", """
SELECT feedback_id, CASE WHEN category IS NULL THEN -1 ELSE c END AS category_code, CASE WHEN channel IS NULL THEN -1 ELSE h END AS channel_code,
  s AS sentiment_label_code FROM coded"""),
    "d26_detect_trend": _w(FB + TL.format(unit="week", src="fb"), """,
x AS (
  SELECT net_sentiment, row_number() OVER (ORDER BY period) AS a, row_number() OVER (ORDER BY period DESC) AS d,
    count(*) OVER () AS n FROM tl
),
g AS (
  SELECT max(n) AS n_periods, avg(net_sentiment) FILTER (WHERE d <= 4) AS recent_avg,
    avg(net_sentiment) FILTER (WHERE a <= greatest(1, n - 4)) AS older_avg FROM x
)
SELECT CAST(n_periods AS INTEGER) AS n_periods,
  CASE WHEN n_periods < 2 THEN 'stable' WHEN recent_avg - older_avg > 5 THEN 'improving'
       WHEN recent_avg - older_avg < -5 THEN 'worsening' ELSE 'stable' END AS direction,
  CASE WHEN n_periods >= 2 THEN round(abs(recent_avg - older_avg), 1) ELSE 0.0 END AS magnitude,
  CASE WHEN n_periods >= 2 THEN round(recent_avg, 1) END AS recent_avg,
  CASE WHEN n_periods >= 2 THEN round(older_avg, 1) END AS older_avg
FROM g"""),
    "d34_text_uniqueness": """
SELECT count(*) AS n_texts, count(DISTINCT text) AS n_distinct, count(*) - count(DISTINCT text) AS n_repeated
FROM documents""",
    "f07_order_by_time": _w(FB, "SELECT feedback_id, created_at FROM fb ORDER BY created_at, feedback_id"),
    "g02_dedup_text": "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text",
    "h01_parse_id_list": """
WITH parts AS (SELECT string_split_regex(' 10, 20,,30 \n abc\n 999999999 ,7,\n', '[\n,]') AS p),
t AS (SELECT CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS position, trim(unnest(p)) AS token FROM parts),
ids AS (SELECT position, token, TRY_CAST(token AS BIGINT) AS customer_id FROM t WHERE token <> '')
SELECT ids.position, ids.token, ids.customer_id, c.c_custkey IS NOT NULL AS found
FROM ids LEFT JOIN customer c ON ids.customer_id = c.c_custkey""",
    "j01_lexicon_sentiment": _lexicon("text", tx.POSITIVE_WORDS, tx.NEGATIVE_WORDS),
    "j01b_lexicon_sentiment_data_words": _lexicon("text", ("the", "and", "with", "for"), ("of", "to", "is", "was")),
    "j02_label_from_compound": _w(EV, "SELECT event_id, sentiment_score, sentiment_label, label_score FROM ev"),
    "j03_expand_confidence": _w(FB, """,
c AS (SELECT feedback_id, sentiment_label, 0.5 + abs(sentiment_score) / 2 AS conf FROM fb)
SELECT feedback_id, sentiment_label,
  round(CASE WHEN sentiment_label = 'positive' THEN conf WHEN sentiment_label = 'negative' THEN (1.0 - conf) * 0.6
       ELSE (1.0 - conf) * 0.5 END, 6) AS p_positive,
  round(CASE WHEN sentiment_label = 'neutral' THEN conf ELSE (1.0 - conf) * 0.4 END, 6) AS p_neutral,
  round(CASE WHEN sentiment_label = 'negative' THEN conf WHEN sentiment_label = 'positive' THEN (1.0 - conf) * 0.6
       ELSE (1.0 - conf) * 0.5 END, 6) AS p_negative
FROM c"""),
    "j04_score_feedback": _w(FB, f""",
j AS (
  SELECT fb.feedback_id, fb.feedback_text,
    CASE WHEN l.doc_id IS NOT NULL THEN fb.sentiment_label END AS existing_label,
    CASE WHEN l.doc_id IS NOT NULL THEN abs(fb.sentiment_score) END AS existing_score
  FROM fb LEFT JOIN labels l ON fb.feedback_id = l.doc_id
),
s AS (
  SELECT *, len(list_intersect({_ws_tokens('feedback_text')}, {lexicon_array_sql(tx.POSITIVE_WORDS)})) AS npos,
    len(list_intersect({_ws_tokens('feedback_text')}, {lexicon_array_sql(tx.NEGATIVE_WORDS)})) AS nneg FROM j
)
SELECT feedback_id,
  coalesce(existing_label, CASE WHEN npos > nneg THEN 'positive' WHEN nneg > npos THEN 'negative' ELSE 'neutral' END)
    AS sentiment_label,
  CASE WHEN existing_label IS NOT NULL THEN existing_score WHEN npos <> nneg THEN 0.7 ELSE 0.5 END AS sentiment_confidence,
  existing_label IS NULL AS was_scored
FROM s"""),
    "j05_tfidf_index": _w(INDEX, "SELECT doc_id, term, round(weight, 6) AS weight FROM post"),
    "j06_tfidf_search": _w(TFIDF_SEARCH, """
SELECT query_id, doc_id, round(s, 4) AS similarity_score, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 10"""),
    "j06b_tfidf_search_filtered": _w(TFIDF_SEARCH.replace(
        "FROM qw JOIN post p ON qw.term = p.term",
        "FROM qw JOIN post p ON qw.term = p.term WHERE p.doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"), """
SELECT query_id, doc_id, round(s, 4) AS similarity_score, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 10"""),
    "j06c_search_hits": _w(FB + "," + TFIDF_SEARCH.replace(
        "FROM qw JOIN post p ON qw.term = p.term",
        "FROM qw JOIN post p ON qw.term = p.term WHERE p.doc_id IN (SELECT feedback_id FROM fb WHERE sentiment_label = 'negative')"), """
SELECT query_id, doc_id, round(s, 4) AS similarity_score, CAST(rank AS INTEGER) AS rank,
  feedback_text, customer_id, category, channel, sentiment_label, sentiment_score, created_at
FROM rk JOIN fb ON fb.feedback_id = rk.doc_id WHERE rank <= 5"""),
    "j07_vector_search": _w(VECTOR, """
SELECT query_id, vec_id, label, round(s, 4) AS similarity, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 10"""),
    "j07b_vector_search_filtered": _w(VECTOR.replace("FROM en, qn WHERE en.n > 0", "FROM en, qn WHERE en.label = 3 AND en.n > 0"), """
SELECT query_id, vec_id, label, round(s, 4) AS similarity, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 10"""),
    "j09_index_stats": "SELECT 'spark-exact-cosine' AS backend, count(*) AS n_documents FROM embeddings",
}
