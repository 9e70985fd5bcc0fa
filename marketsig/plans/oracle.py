"""DuckDB SQL equivalents of the catalog queries (the correctness oracle).

Tables are the pre-registered views of the landed parquet files.
"""

RSI_BASE = """
WITH b AS (
  SELECT user_id, event_id, value,
         row_number() OVER w - 1 AS idx,
         coalesce(value - lag(value) OVER w, 0) AS d
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (
  SELECT user_id, event_id, idx,
         sum(greatest(d, 0)) OVER w14 AS g, sum(greatest(-d, 0)) OVER w14 AS l
  FROM b WINDOW w14 AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
"""

ORACLE = {
    "rsi_14": RSI_BASE + """
SELECT user_id, event_id,
       round(CASE WHEN idx < 13 THEN NULL
                  WHEN l = 0 THEN CASE WHEN g = 0 THEN NULL ELSE 100.0 END
                  ELSE 100.0 - 100.0 / (1.0 + g / l) END, 4) AS rsi_14
FROM s""",

    "ema_macd": """
WITH RECURSIVE b AS (
  SELECT user_id, event_id, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (
  SELECT user_id, rn, event_id, value AS f, value AS s, CAST(0 AS DOUBLE) AS sig FROM b WHERE rn = 1
  UNION ALL
  SELECT b.user_id, b.rn, b.event_id,
         r.f * (1 - 2.0::DOUBLE / 13) + b.value * (2.0::DOUBLE / 13),
         r.s * (1 - 2.0::DOUBLE / 27) + b.value * (2.0::DOUBLE / 27),
         r.sig * (1 - 2.0::DOUBLE / 10)
           + ((r.f * (1 - 2.0::DOUBLE / 13) + b.value * (2.0::DOUBLE / 13))
              - (r.s * (1 - 2.0::DOUBLE / 27) + b.value * (2.0::DOUBLE / 27))) * (2.0::DOUBLE / 10)
  FROM r JOIN b ON b.user_id = r.user_id AND b.rn = r.rn + 1)
SELECT user_id, event_id, round(f - s, 4) AS macd, round(sig, 4) AS signal,
       round(f - s - sig, 4) AS histogram
FROM r""",

    "price_delta": """
SELECT user_id, event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta
FROM events""",

    "rolling_mean": """
SELECT user_id, event_id,
       round(CASE WHEN row_number() OVER w >= 14
                  THEN avg(value) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) END, 4) AS mean_14
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",

    "ohlcv_daily": """
SELECT event_type AS ticker, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS date,
       arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
       arg_max(value, (ts, event_id)) AS close, count(*) AS volume
FROM events GROUP BY event_type, CAST(ts AS DATE)""",

    "lookback_1mo": """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders
WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 1 MONTH""",

    "indicators_latest": """
WITH RECURSIVE bars AS (
  SELECT event_type, CAST(ts AS DATE) AS date, arg_max(value, (ts, event_id)) AS close
  FROM events GROUP BY event_type, CAST(ts AS DATE)),
b AS (
  SELECT event_type, date, close, row_number() OVER w - 1 AS idx,
         coalesce(close - lag(close) OVER w, 0) AS d
  FROM bars WINDOW w AS (PARTITION BY event_type ORDER BY date)),
s AS (
  SELECT *, sum(greatest(d, 0)) OVER w14 AS g, sum(greatest(-d, 0)) OVER w14 AS l
  FROM b WINDOW w14 AS (PARTITION BY event_type ORDER BY idx ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
r AS (
  SELECT event_type, idx, close AS f, close AS s, CAST(0 AS DOUBLE) AS sig FROM b WHERE idx = 0
  UNION ALL
  SELECT b.event_type, b.idx,
         r.f * (1 - 2.0::DOUBLE / 13) + b.close * (2.0::DOUBLE / 13),
         r.s * (1 - 2.0::DOUBLE / 27) + b.close * (2.0::DOUBLE / 27),
         r.sig * (1 - 2.0::DOUBLE / 10)
           + ((r.f * (1 - 2.0::DOUBLE / 13) + b.close * (2.0::DOUBLE / 13))
              - (r.s * (1 - 2.0::DOUBLE / 27) + b.close * (2.0::DOUBLE / 27))) * (2.0::DOUBLE / 10)
  FROM r JOIN b ON b.event_type = r.event_type AND b.idx = r.idx + 1),
j AS (
  SELECT s.event_type, s.date, s.close,
         CASE WHEN s.idx < 13 THEN NULL WHEN s.l = 0 THEN CASE WHEN s.g = 0 THEN NULL ELSE 100.0 END
              ELSE 100.0 - 100.0 / (1.0 + s.g / s.l) END AS rsi,
         r.f - r.s AS macd, r.sig AS signal, r.f - r.s - r.sig AS histogram,
         row_number() OVER (PARTITION BY s.event_type ORDER BY s.idx DESC) AS back
  FROM s JOIN r ON r.event_type = s.event_type AND r.idx = s.idx)
SELECT event_type AS ticker, CAST(date AS TIMESTAMP) AS date, close, round(rsi, 4) AS rsi, round(macd, 4) AS macd,
       round(signal, 4) AS signal, round(histogram, 4) AS histogram,
       CASE WHEN rsi > 70 THEN 'overbought' WHEN rsi < 30 THEN 'oversold'
            WHEN rsi IS NOT NULL THEN 'neutral' END AS rsi_zone,
       CASE WHEN macd > signal THEN 'bullish' WHEN macd < signal THEN 'bearish' ELSE 'neutral' END AS macd_trend,
       CASE WHEN histogram > 0 THEN 'increasing' WHEN histogram < 0 THEN 'decreasing' ELSE 'flat' END AS momentum,
       CASE WHEN (CASE WHEN macd > signal THEN 1 WHEN macd < signal THEN -1 ELSE 0 END)
                 + (CASE WHEN rsi < 30 THEN 1 WHEN rsi > 70 THEN -1 ELSE 0 END) > 0 THEN 'bullish'
            WHEN (CASE WHEN macd > signal THEN 1 WHEN macd < signal THEN -1 ELSE 0 END)
                 + (CASE WHEN rsi < 30 THEN 1 WHEN rsi > 70 THEN -1 ELSE 0 END) < 0 THEN 'bearish'
            ELSE 'neutral' END AS outlook
FROM j WHERE back = 1""",
}


def _softmax_select(key: str, extra: str = "") -> str:
    """Probabilities, label, confidence and signed score from logits a, b, c."""
    return f"""
e AS (SELECT *, exp(a - greatest(a, b, c)) AS ea, exp(b - greatest(a, b, c)) AS eb,
             exp(c - greatest(a, b, c)) AS ec FROM l),
p AS (SELECT *, ea / (ea + eb + ec) AS pn, eb / (ea + eb + ec) AS pu, ec / (ea + eb + ec) AS pp FROM e)
SELECT {key}, {extra} round(pn, 6) AS p_negative, round(pu, 6) AS p_neutral, round(pp, 6) AS p_positive,
       CASE WHEN pn >= pu AND pn >= pp THEN 'negative' WHEN pu >= pp THEN 'neutral' ELSE 'positive' END
         AS sentiment,
       {"round(greatest(pn, pu, pp), 6) AS confidence," if not extra else ""} round(pp - pn, 6) AS score
FROM p"""


_FIRST10 = """
SELECT source, pos, doc_id, n_chars FROM (
  SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos
  FROM documents) WHERE pos < 10 AND n_chars >= 100"""

_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _clean(x: str) -> str:
    t = f"regexp_replace({x}, '<[^>]+>', '', 'g')"
    t = _STRIP.format(x=t)
    t = rf"regexp_replace({t}, '\s[-|]\s+[A-Z][A-Za-z\s]+$', '')"
    t = rf"regexp_replace({t}, '\s+', ' ', 'g')"
    return _STRIP.format(x=t)


ORACLE.update({
    "quotes_decode": """
WITH e AS (SELECT event_id, event_type, value,
                  CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS DOUBLE) AS k FROM events),
q AS (SELECT event_id, event_type AS ticker,
             CASE WHEN k = 0 THEN CAST(0 AS DOUBLE) ELSE value END AS current_price,
             (k - 50.0) / 10.0 AS change, (k - 50.0) / 4.0 AS percent_change,
             value + k / 100.0 AS high, value - k / 100.0 AS low,
             value - (k - 50.0) / 20.0 AS open, value - (k - 50.0) / 10.0 AS previous_close FROM e)
SELECT * FROM q WHERE current_price IS NULL OR current_price <> 0""",

    "universe_filter": """
SELECT event_id, user_id, upper(event_type) AS ticker, value FROM events
WHERE upper(event_type) IN ('CLICK', 'PURCHASE', 'VIEW')""",

    "source_fallback": """
WITH p AS (SELECT source, doc_id, 'primary' AS feed FROM documents WHERE lang = 'en' AND n_chars < 300),
s AS (SELECT source, doc_id, 'secondary' AS feed FROM documents WHERE NOT (lang = 'en' AND n_chars < 300))
SELECT * FROM p UNION ALL
SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.source = s.source)""",

    "news_first_n": _FIRST10,

    "headline_batches": f"""
SELECT source, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY pos) AS doc_ids
FROM ({_FIRST10}) GROUP BY source""",

    "url_dedup": """
WITH f AS (SELECT md5(text) AS url, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source
           FROM documents GROUP BY md5(text))
SELECT url, doc_id, source FROM f
WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.lang = 'de' AND md5(d.text) = f.url)""",

    "quote_insert_ignore": """
SELECT l_partkey, l_shipdate, l_orderkey, l_linenumber, l_extendedprice FROM lineitem i
WHERE l_returnflag <> 'R'
  AND NOT EXISTS (SELECT 1 FROM lineitem e WHERE e.l_returnflag = 'R'
                  AND e.l_partkey = i.l_partkey AND e.l_shipdate = i.l_shipdate)
QUALIFY row_number() OVER (PARTITION BY l_partkey, l_shipdate ORDER BY l_orderkey, l_linenumber) = 1""",

    "score_update": """
SELECT d.doc_id, d.lang,
       coalesce(CAST(l.quality - l.toxic AS DOUBLE),
                CAST(CASE WHEN d.lang = 'en' THEN 0.1 WHEN d.lang = 'fr' THEN -0.1 END AS DOUBLE))
         AS sentiment_score
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",

    "validate_ledger": """
WITH r AS (
  SELECT o_orderkey AS id, o_orderpriority AS ticker,
         CASE WHEN o_orderstatus = 'P' THEN 'BUY' WHEN o_orderstatus = 'F' THEN 'SELL'
              WHEN o_orderpriority = '5-LOW' THEN 'WAIT' ELSE 'HOLD' END AS action,
         o_totalprice * 250.0 AS price, (o_totalprice % 200.0 - 100.0) / 100.0 AS sentiment_avg,
         o_totalprice / 5000.0 AS rsi, CAST(NULL AS DOUBLE) AS macd,
         CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' THEN NULL ELSE o_orderdate END AS ts
  FROM orders),
c AS (
  SELECT id, nullif(concat_ws('; ',
    CASE WHEN id IS NULL THEN 'id is null' END,
    CASE WHEN ticker IS NULL THEN 'ticker is null' END,
    CASE WHEN action IS NULL THEN 'action is null' END,
    CASE WHEN action IS NULL THEN 'approved is null' END,
    CASE WHEN ts IS NULL THEN 'timestamp is null' END,
    CASE WHEN action NOT IN ('BUY', 'SELL', 'HOLD') THEN 'action not in BUY/SELL/HOLD' END,
    CASE WHEN length(ticker) > 10 THEN 'ticker longer than 10' END,
    CASE WHEN price IS NOT NULL AND TRY_CAST(price AS DECIMAL(12,4)) IS NULL
         THEN 'price overflows decimal(12,4)' END,
    CASE WHEN sentiment_avg IS NOT NULL AND TRY_CAST(sentiment_avg AS DECIMAL(6,4)) IS NULL
         THEN 'sentiment_avg overflows decimal(6,4)' END,
    CASE WHEN rsi IS NOT NULL AND TRY_CAST(rsi AS DECIMAL(6,2)) IS NULL THEN 'rsi overflows decimal(6,2)' END,
    CASE WHEN macd IS NOT NULL AND TRY_CAST(macd AS DECIMAL(12,4)) IS NULL
         THEN 'macd overflows decimal(12,4)' END), '') AS reason
  FROM r)
SELECT id, reason IS NULL AS valid, reason FROM c""",

    "clean_headlines": f"""
WITH t AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages),
r AS (SELECT page_id,
             CASE page_id % 3 WHEN 0 THEN title || ' - Reuters' WHEN 1 THEN '<b>' || title || '</b>'
                  ELSE title || ' | Bloomberg News' END AS raw_headline FROM t)
SELECT page_id, raw_headline, {_clean('raw_headline')} AS headline FROM r""",

    "timestamps": """
WITH e AS (SELECT event_id, ts, CAST(floor(epoch(ts)) AS BIGINT) AS secs FROM events),
f AS (SELECT event_id, ts,
             CASE WHEN event_id % 4 = 0 THEN 0 ELSE secs END AS pt,
             CASE WHEN event_id % 5 = 0 THEN NULL ELSE secs + 30 END AS pa,
             CASE WHEN event_id % 3 = 0 THEN '' ELSE 'https://news.example/' || event_id END AS link,
             'https://feed.example/' || event_id AS url0,
             CASE WHEN event_id % 2 = 0 THEN ts END AS created FROM e),
g AS (SELECT *, TIMESTAMP '1970-01-01' + to_seconds(coalesce(nullif(pt, 0), pa)) AS published_at FROM f)
SELECT event_id, published_at, coalesce(nullif(link, ''), url0) AS url,
       strptime(substr(strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' GMT', 6, 20), '%d %b %Y %H:%M:%S')
         AS rss_published,
       coalesce(created, published_at) AS seen_at
FROM g""",

    "softmax_label": """
WITH l AS (SELECT vec_id,
                  list_sum(list_transform(list_filter(embedding, lambda x, i: (i - 1) % 3 = 0), lambda x: CAST(x AS DOUBLE))) AS a,
                  list_sum(list_transform(list_filter(embedding, lambda x, i: (i - 1) % 3 = 1), lambda x: CAST(x AS DOUBLE))) AS b,
                  list_sum(list_transform(list_filter(embedding, lambda x, i: (i - 1) % 3 = 2), lambda x: CAST(x AS DOUBLE))) AS c
           FROM embeddings),""" + _softmax_select("vec_id"),

    "lexicon_score": """
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS toks
           FROM documents),
n AS (SELECT doc_id, len(toks) AS n_tokens,
             len(list_filter(toks, lambda x: x IN ('and', 'with', 'und', 'et', 'for'))) AS n_pos,
             len(list_filter(toks, lambda x: x IN ('of', 'der', 'que', 'to', 'die'))) AS n_neg FROM t),
l AS (SELECT doc_id, n_tokens, n_pos, n_neg,
             CAST(100.0 AS DOUBLE) * n_neg / greatest(n_tokens, 1) AS a, CAST(1.0 AS DOUBLE) AS b,
             CAST(100.0 AS DOUBLE) * n_pos / greatest(n_tokens, 1) AS c FROM n),"""
    + _softmax_select("doc_id", "n_tokens, n_pos, n_neg,"),

    "net_sentiment": """
WITH d AS (SELECT doc_id, source || ':' || lang AS ticker FROM documents),
s AS (SELECT d.ticker, CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive'
                            ELSE 'neutral' END AS sentiment
      FROM d JOIN labels l ON l.doc_id = d.doc_id),
a AS (SELECT ticker, count(*) FILTER (WHERE sentiment = 'positive') AS p,
             count(*) FILTER (WHERE sentiment = 'negative') AS n,
             count(*) FILTER (WHERE sentiment = 'neutral') AS u, count(*) AS t FROM s GROUP BY ticker),
j AS (SELECT u.ticker, coalesce(p, 0) AS p, coalesce(n, 0) AS n, coalesce(a.u, 0) AS u, coalesce(t, 0) AS t
      FROM (SELECT DISTINCT ticker FROM d) u LEFT JOIN a ON a.ticker = u.ticker),
k AS (SELECT *, coalesce(CAST(p - n AS DOUBLE) / nullif(t, 0), 0.0) AS avg_score FROM j)
SELECT ticker, p AS positive_count, n AS negative_count, u AS neutral_count, t AS total_headlines,
       avg_score,
       CASE WHEN avg_score > 0.2 THEN 'positive' WHEN avg_score < -0.2 THEN 'negative' ELSE 'neutral' END
         AS avg_sentiment,
       coalesce(CAST(p AS DOUBLE) / nullif(t, 0), 0.0) AS positive_ratio,
       coalesce(CAST(n AS DOUBLE) / nullif(t, 0), 0.0) AS negative_ratio,
       coalesce(CAST(u AS DOUBLE) / nullif(t, 0), 0.0) AS neutral_ratio
FROM k""",

    "weighted_score": """
WITH n AS (SELECT event_type AS ticker, ts AS created_at,
                  CAST((event_id * 37) % 201 - 100 AS DOUBLE) / 100.0 AS s FROM events),
m AS (SELECT max(ts) AS as_of FROM events),
f AS (SELECT ticker, s, CASE WHEN created_at >= as_of - INTERVAL 720 MINUTE THEN 2.0 ELSE 1.0 END AS w
      FROM n, m WHERE s IS NOT NULL AND created_at >= as_of - INTERVAL 4320 MINUTE),
a AS (SELECT ticker, coalesce(CAST(sum(CAST(s * w AS DECIMAL(38,14))) AS DOUBLE) / nullif(sum(w), 0), 0.0) AS raw, count(*) AS articles_count
      FROM f GROUP BY ticker),
x AS (SELECT *, round(raw, 4) AS score FROM a)
SELECT ticker, score AS score, round(raw, 6) AS raw_score, abs(raw) >= 0.7 AS alert, articles_count,
       CASE WHEN raw > 0 THEN 'positive' WHEN raw < 0 THEN 'negative' ELSE 'neutral' END AS direction,
       CASE WHEN score > 0.2 THEN 'positive' WHEN score < -0.2 THEN 'negative' ELSE 'neutral' END
         AS avg_sentiment,
       round(greatest(0.0, score), 4) AS positive_ratio, round(greatest(0.0, -score), 4) AS negative_ratio,
       round(greatest(0.0, 1.0 - abs(score)), 4) AS neutral_ratio
FROM x""",
})


_REPLY_LINES = [
    "DECISION: BUY\nCONFIDENCE: HIGH",
    "decision: sell\nconfidence: medium",
    "**DECISION:** BUY",
    "DECISION: [SELL]",
    "DECISION: hold\nCONFIDENCE: LOW",
    "",
    "Decision:BUY Decision: SELL\nConfidence:high",
]


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_REPLIES = f"""
rr AS (SELECT conv_id, turn,
             CASE WHEN turn % 3 = 0 THEN '' ELSE '<think>' || text || '</think>' || chr(10) END
             || [{", ".join(_sql_str(x) for x in _REPLY_LINES)}][conv_id % 7 + 1]
             || chr(10) || 'REASONING: ' || text AS reply
      FROM conversations WHERE role = 'assistant'),
ff AS (SELECT *, {_STRIP.format(x="regexp_replace(reply, '(?s)<think>.*?</think>', '', 'g')")} AS ans FROM rr)"""

ORACLE.update({
    "topk_trades": """
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank
FROM orders QUALIFY rank <= 5""",

    "topk_all": """
SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20""",

    "topk_sentiment": """
SELECT l_suppkey, l_orderkey, l_linenumber, l_shipdate,
       row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC)
         AS rank
FROM lineitem QUALIFY rank <= 10""",

    "trade_history_asof": """
WITH t AS (
  SELECT o_custkey, o_orderkey, o_orderdate AS ts,
         CASE WHEN o_orderstatus = 'P' THEN 'BUY' WHEN o_orderstatus = 'F' THEN 'SELL' ELSE 'HOLD' END AS action,
         o_totalprice AS price, (o_totalprice % 200.0 - 100.0) / 101.0 AS sentiment_avg,
         o_totalprice / 5003.0 AS rsi, o_orderpriority AS reasoning FROM orders),
h AS (
  SELECT o_custkey, o_orderkey,
         list(printf('%s: %s at $%.2f (Sentiment: %.2f, RSI: %.1f) - %s' || chr(10),
                     strftime(ts, '%Y-%m-%d'), action, price, sentiment_avg, rsi, reasoning))
           OVER (PARTITION BY o_custkey ORDER BY ts DESC, o_orderkey DESC
                 ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS lines
  FROM t)
SELECT o_custkey, o_orderkey,
       CASE WHEN len(lines) > 0
            THEN chr(10) || chr(10) || 'HISTORICAL CONTEXT (Past 5 trades for this stock):' || chr(10)
                 || array_to_string(list_transform(lines, lambda x, i: CAST(i AS VARCHAR) || '. ' || x), '')
            ELSE '' END AS history_context
FROM h""",

    "parse_decision": f"""
WITH {_REPLIES}
SELECT conv_id, turn,
       coalesce(upper(nullif(regexp_extract(ans, '(?i)DECISION:\\s*(BUY|SELL|HOLD)', 1), '')), 'HOLD')
         AS decision,
       coalesce(upper(nullif(regexp_extract(ans, '(?i)CONFIDENCE:\\s*(HIGH|MEDIUM|LOW)', 1), '')), 'LOW')
         AS confidence,
       coalesce(nullif({_STRIP.format(x="regexp_extract(ans, '(?i)REASONING:\\s*(.+?)(?:\\n|$)', 1)")}, ''),
                'No reasoning provided') AS reasoning,
       {_STRIP.format(x="regexp_extract(reply, '(?s)<think>(.*?)</think>', 1)")} AS thinking_process,
       coalesce(upper(nullif(regexp_extract(ans, '(?i)DECISION:\\s*(BUY|SELL|HOLD)', 1), '')), 'HOLD')
         IN ('BUY', 'SELL') AS approved
FROM ff""",
})


_LEX_SCORE = """
tok AS (SELECT *, list_filter(regexp_split_to_array(lower(headline), '[^a-z]+'), lambda x: x <> '') AS toks
        FROM new),
cnt AS (SELECT *, len(toks) AS n_tokens,
               len(list_filter(toks, lambda x: x IN ('and', 'with', 'und', 'et', 'for'))) AS n_pos,
               len(list_filter(toks, lambda x: x IN ('of', 'der', 'que', 'to', 'die'))) AS n_neg FROM tok),
lg AS (SELECT *, CAST(100.0 AS DOUBLE) * n_neg / greatest(n_tokens, 1) AS a, CAST(1.0 AS DOUBLE) AS b,
              CAST(100.0 AS DOUBLE) * n_pos / greatest(n_tokens, 1) AS c FROM cnt),
ex2 AS (SELECT *, exp(a - greatest(a, b, c)) AS ea, exp(b - greatest(a, b, c)) AS eb,
               exp(c - greatest(a, b, c)) AS ec FROM lg),
scored AS (SELECT ticker, url, created_at, ec / (ea + eb + ec) - ea / (ea + eb + ec) AS sentiment_score
           FROM ex2)"""

_EMA_STEP = """
         r.f * (1 - 2.0::DOUBLE / 13) + b.value * (2.0::DOUBLE / 13),
         r.s * (1 - 2.0::DOUBLE / 27) + b.value * (2.0::DOUBLE / 27),
         r.sig * (1 - 2.0::DOUBLE / 10)
           + ((r.f * (1 - 2.0::DOUBLE / 13) + b.value * (2.0::DOUBLE / 13))
              - (r.s * (1 - 2.0::DOUBLE / 27) + b.value * (2.0::DOUBLE / 27))) * (2.0::DOUBLE / 10)"""

ORACLE.update({
    "news_signals": """
WITH a AS (SELECT d.doc_id, d.source AS ticker, d.lang, d.n_chars, d.text AS headline, md5(d.text) AS url,
                  e.ts AS created_at
           FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id),
p AS (SELECT * FROM a WHERE lang = 'en' AND n_chars < 300),
s AS (SELECT * FROM a WHERE NOT (lang = 'en' AND n_chars < 300)),
feed AS (SELECT * FROM p UNION ALL SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.ticker = s.ticker)),
feed2 AS (SELECT * FROM feed WHERE coalesce(url, '') <> ''),
ex AS (SELECT a.ticker, a.url, a.created_at, CAST(l.quality - l.toxic AS DOUBLE) AS sentiment_score
       FROM a LEFT JOIN labels l ON l.doc_id = a.doc_id WHERE a.lang = 'de'),
first AS (SELECT * FROM feed2 QUALIFY row_number() OVER (PARTITION BY url ORDER BY created_at NULLS FIRST, doc_id) = 1),
new AS (SELECT * FROM first f WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.url = f.url)),""" + _LEX_SCORE + """,
stored AS (SELECT ticker, url, created_at, sentiment_score FROM ex
           UNION ALL SELECT ticker, url, created_at, sentiment_score FROM scored),
m AS (SELECT max(created_at) AS as_of FROM a),
w AS (SELECT st.ticker, st.sentiment_score AS sc,
             CASE WHEN created_at >= as_of - INTERVAL 360 MINUTE THEN 2.0 ELSE 1.0 END AS w
      FROM stored st, m
      WHERE st.ticker IN (SELECT ticker FROM feed2) AND sentiment_score IS NOT NULL
        AND created_at >= as_of - INTERVAL 1440 MINUTE),
agg AS (SELECT ticker, coalesce(CAST(sum(CAST(sc * w AS DECIMAL(38,14))) AS DOUBLE) / nullif(sum(w), 0), 0.0) AS raw, count(*) AS n FROM w GROUP BY ticker),
u AS (SELECT DISTINCT source AS ticker FROM documents),
j AS (SELECT u.ticker, coalesce(raw, 0.0) AS raw, coalesce(n, 0) AS n FROM u LEFT JOIN agg ON agg.ticker = u.ticker)
SELECT ticker, round(raw, 4) AS score, round(raw, 6) AS raw_score, abs(raw) >= 0.7 AS alert,
       n AS articles_count,
       CASE WHEN raw > 0 THEN 'positive' WHEN raw < 0 THEN 'negative' ELSE 'neutral' END AS direction
FROM j""",

    "signal_assembly": f"""
WITH RECURSIVE
ev AS (SELECT 'U' || user_id AS ticker, user_id, event_id, ts, value,
              CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS DOUBLE) AS k FROM events),
m AS (SELECT max(ts) AS as_of FROM events),
lq AS (SELECT ticker, arg_max(value, (ts, event_id)) AS value, arg_max(k, (ts, event_id)) AS k
       FROM ev GROUP BY ticker),
q AS (SELECT ticker, CASE WHEN k % 20 = 0 THEN CAST(0 AS DOUBLE) ELSE value END AS current_price,
             (k - 50.0) / 10.0 AS change, (k - 50.0) / 4.0 AS percent_change,
             value + k / 100.0 AS high, value - k / 100.0 AS low, value - (k - 50.0) / 10.0 AS previous_close
      FROM lq),
q2 AS (SELECT * FROM q WHERE current_price IS NULL OR current_price <> 0),
hist AS (SELECT ev.* FROM ev, m WHERE ts >= as_of - INTERVAL 1 MONTH),
b AS (SELECT ticker, value, row_number() OVER w - 1 AS idx, coalesce(value - lag(value) OVER w, 0) AS d
      FROM hist WINDOW w AS (PARTITION BY ticker ORDER BY ts, event_id)),
s AS (SELECT *, sum(greatest(d, 0)) OVER w14 AS g, sum(greatest(-d, 0)) OVER w14 AS l
      FROM b WINDOW w14 AS (PARTITION BY ticker ORDER BY idx ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
r AS (SELECT ticker, idx, value AS f, value AS s, CAST(0 AS DOUBLE) AS sig FROM b WHERE idx = 0
      UNION ALL
      SELECT b.ticker, b.idx, {_EMA_STEP}
      FROM r JOIN b ON b.ticker = r.ticker AND b.idx = r.idx + 1),
tech AS (SELECT s.ticker,
                CASE WHEN s.idx < 13 THEN NULL WHEN s.l = 0 THEN CASE WHEN s.g = 0 THEN NULL ELSE 100.0 END
                     ELSE 100.0 - 100.0 / (1.0 + s.g / s.l) END AS rsi,
                r.f - r.s AS macd, r.sig AS signal, r.f - r.s - r.sig AS histogram
         FROM s JOIN r ON r.ticker = s.ticker AND r.idx = s.idx
         QUALIFY row_number() OVER (PARTITION BY s.ticker ORDER BY s.idx DESC) = 1),
news AS (SELECT ticker, event_id, ts AS created_at, CAST((event_id * 37) % 201 - 100 AS DOUBLE) / 100.0 AS sc
         FROM ev),
wn AS (SELECT ticker, sc, CASE WHEN created_at >= as_of - INTERVAL 360 MINUTE THEN 2.0 ELSE 1.0 END AS w
       FROM news, m WHERE created_at >= as_of - INTERVAL 1440 MINUTE),
agg AS (SELECT ticker, CAST(sum(CAST(sc * w AS DECIMAL(38,14))) AS DOUBLE) / nullif(sum(w), 0) AS raw, count(*) AS n FROM wn GROUP BY ticker),
u AS (SELECT DISTINCT ticker FROM ev),
al AS (SELECT u.ticker, coalesce(raw, 0.0) AS raw, coalesce(n, 0) AS n, round(coalesce(raw, 0.0), 4) AS score
       FROM u LEFT JOIN agg ON agg.ticker = u.ticker),
heads AS (SELECT ticker, CASE WHEN sc > 0.33 THEN 'positive' WHEN sc < -0.33 THEN 'negative' ELSE 'neutral' END
                 AS sentiment
          FROM news QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY created_at DESC, event_id DESC) <= 10),
hc AS (SELECT ticker, count(*) FILTER (WHERE sentiment = 'positive') AS p,
              count(*) FILTER (WHERE sentiment = 'negative') AS ng, count(*) FILTER (WHERE sentiment = 'neutral') AS nu,
              count(*) AS t FROM heads GROUP BY ticker),
cp AS (SELECT u.ticker, coalesce(p, 0) AS p, coalesce(ng, 0) AS ng, coalesce(nu, 0) AS nu, coalesce(t, 0) AS t
       FROM u LEFT JOIN hc ON hc.ticker = u.ticker),
sent AS (SELECT al.ticker,
                CASE WHEN n > 0 THEN CASE WHEN score > 0.2 THEN 'positive' WHEN score < -0.2 THEN 'negative'
                                          ELSE 'neutral' END
                     ELSE CASE WHEN coalesce(CAST(p - ng AS DOUBLE) / nullif(t, 0), 0.0) > 0.2 THEN 'positive'
                               WHEN coalesce(CAST(p - ng AS DOUBLE) / nullif(t, 0), 0.0) < -0.2 THEN 'negative'
                               ELSE 'neutral' END END AS avg_sentiment,
                CASE WHEN n > 0 THEN round(score, 4) ELSE coalesce(CAST(p - ng AS DOUBLE) / nullif(t, 0), 0.0) END
                  AS avg_score,
                CASE WHEN n > 0 THEN round(greatest(0.0, score), 4)
                     ELSE coalesce(CAST(p AS DOUBLE) / nullif(t, 0), 0.0) END AS positive_ratio,
                CASE WHEN n > 0 THEN round(greatest(0.0, -score), 4)
                     ELSE coalesce(CAST(ng AS DOUBLE) / nullif(t, 0), 0.0) END AS negative_ratio,
                CASE WHEN n > 0 THEN round(greatest(0.0, 1.0 - abs(score)), 4)
                     ELSE coalesce(CAST(nu AS DOUBLE) / nullif(t, 0), 0.0) END AS neutral_ratio,
                CASE WHEN n > 0 THEN n ELSE t END AS total_headlines,
                CASE WHEN n > 0 THEN 'news_engine' ELSE 'headlines' END AS sentiment_source
         FROM al JOIN cp ON cp.ticker = al.ticker),
{_REPLIES},
rep AS (SELECT 'U' || conv_id AS ticker, reply, ans FROM ff
        QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
j AS (SELECT u.ticker, al.score AS news_score, abs(al.raw) >= 0.7 AS news_alert, al.n AS news_count,
             CASE WHEN al.raw > 0 THEN 'positive' WHEN al.raw < 0 THEN 'negative' ELSE 'neutral' END
               AS news_direction,
             q2.current_price, q2.change, q2.percent_change, q2.high, q2.low, q2.previous_close,
             CASE WHEN q2.ticker IS NULL THEN 'Failed to fetch market data for ' || u.ticker
                  WHEN tech.ticker IS NULL THEN 'No price history available for technical analysis' END AS error,
             sent.*, tech.rsi, tech.macd, tech.signal, tech.histogram, rep.reply, rep.ans
      FROM u JOIN al ON al.ticker = u.ticker LEFT JOIN q2 ON q2.ticker = u.ticker
      LEFT JOIN tech ON tech.ticker = u.ticker JOIN sent ON sent.ticker = u.ticker
      LEFT JOIN rep ON rep.ticker = u.ticker),
d AS (SELECT *,
             CASE WHEN reply IS NULL THEN 'HOLD'
                  ELSE coalesce(upper(nullif(regexp_extract(ans, '(?i)DECISION:\\s*(BUY|SELL|HOLD)', 1), '')), 'HOLD')
             END AS dec,
             CASE WHEN reply IS NULL THEN 'LOW'
                  ELSE coalesce(upper(nullif(regexp_extract(ans, '(?i)CONFIDENCE:\\s*(HIGH|MEDIUM|LOW)', 1), '')),
                                'LOW') END AS conf,
             CASE WHEN reply IS NULL THEN 'Error in decision making: no reply from the decision model'
                  ELSE coalesce(nullif({_STRIP.format(x="regexp_extract(ans, '(?i)REASONING:\\s*(.+?)(?:\\n|$)', 1)")},
                                       ''), 'No reasoning provided') END AS why
      FROM j)
SELECT ticker, news_score, news_alert, news_count, news_direction, current_price, change, percent_change,
       high, low, previous_close,
       CASE WHEN error IS NULL THEN avg_sentiment END AS avg_sentiment,
       CASE WHEN error IS NULL THEN avg_score END AS avg_score,
       CASE WHEN error IS NULL THEN positive_ratio END AS positive_ratio,
       CASE WHEN error IS NULL THEN negative_ratio END AS negative_ratio,
       CASE WHEN error IS NULL THEN neutral_ratio END AS neutral_ratio,
       CASE WHEN error IS NULL THEN total_headlines END AS total_headlines,
       CASE WHEN error IS NULL THEN sentiment_source END AS sentiment_source,
       CASE WHEN error IS NULL THEN round(rsi, 4) END AS rsi,
       CASE WHEN error IS NULL THEN round(macd, 4) END AS macd,
       CASE WHEN error IS NULL THEN round(signal, 4) END AS signal,
       CASE WHEN error IS NULL THEN round(histogram, 4) END AS histogram,
       CASE WHEN error IS NULL THEN CASE WHEN rsi > 70 THEN 'overbought' WHEN rsi < 30 THEN 'oversold'
                                         WHEN rsi IS NOT NULL THEN 'neutral' END END AS rsi_zone,
       CASE WHEN error IS NULL THEN CASE WHEN macd > signal THEN 'bullish' WHEN macd < signal THEN 'bearish'
                                         ELSE 'neutral' END END AS macd_trend,
       CASE WHEN error IS NULL THEN CASE WHEN histogram > 0 THEN 'increasing' WHEN histogram < 0 THEN 'decreasing'
                                         ELSE 'flat' END END AS momentum,
       CASE WHEN error IS NULL THEN
         CASE WHEN (CASE WHEN macd > signal THEN 1 WHEN macd < signal THEN -1 ELSE 0 END)
                   + (CASE WHEN rsi < 30 THEN 1 WHEN rsi > 70 THEN -1 ELSE 0 END) > 0 THEN 'bullish'
              WHEN (CASE WHEN macd > signal THEN 1 WHEN macd < signal THEN -1 ELSE 0 END)
                   + (CASE WHEN rsi < 30 THEN 1 WHEN rsi > 70 THEN -1 ELSE 0 END) < 0 THEN 'bearish'
              ELSE 'neutral' END END AS outlook,
       CASE WHEN error IS NULL THEN dec END AS decision,
       CASE WHEN error IS NULL THEN conf END AS confidence,
       CASE WHEN error IS NULL THEN why END AS reasoning,
       CASE WHEN error IS NULL THEN dec IN ('BUY', 'SELL') END AS approved,
       error
FROM d""",
})


# ---- report and prompt tables: the same fixed templates rendered with printf

import re as _re  # noqa: E402

from marketsig.plans.prompts import ANALYSIS, DECISION_PROMPT, NEWS_ALERT_BLOCK, TECHNICAL_PROMPT  # noqa: E402
from marketsig.plans.report import DETAIL  # noqa: E402

_SLOT = _re.compile(r"\{([A-Za-z_][A-Za-z0-9_]*)(?::([^}]*))?\}")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _slot_sql(expr: str, spec: str | None) -> str:
    if not spec:
        return f"coalesce(CAST({expr} AS VARCHAR), 'None')"
    m = _re.fullmatch(r"(\+?)\.(\d+)([f%])", spec)
    sign, digits, kind = m.group(1), m.group(2), m.group(3)
    if kind == "%":
        return f"coalesce(printf('%.{digits}f', ({expr}) * 100.0) || '%', 'nan%')"
    if sign:
        return f"coalesce(printf('%+.{digits}f', ({expr})), 'nan')"
    return f"coalesce(printf('%.{digits}f', {expr}), 'nan')"


def render_sql(template: str, exprs: dict | None = None) -> str:
    exprs = exprs or {}
    parts, pos = [], 0
    for m in _SLOT.finditer(template):
        if m.start() > pos:
            parts.append(_q(template[pos:m.start()]))
        parts.append(_slot_sql(exprs.get(m.group(1), m.group(1)), m.group(2)))
        pos = m.end()
    if pos < len(template):
        parts.append(_q(template[pos:]))
    return "(" + " || ".join(parts) + ")"


_SA = f"sa AS (SELECT * FROM ({ORACLE['signal_assembly']}) AS x)"

ORACLE.update({
    "prompts": f"""
WITH {_SA},
p AS (SELECT *, '' AS history_context,
             CASE WHEN news_alert THEN {render_sql(NEWS_ALERT_BLOCK, {"news_dir": "upper(news_direction)"})}
                  ELSE '' END AS news_context,
             coalesce({render_sql(ANALYSIS)}, 'N/A') AS analysis
      FROM sa WHERE error IS NULL)
SELECT ticker, {render_sql(TECHNICAL_PROMPT)} AS technical_prompt, {render_sql(DECISION_PROMPT)} AS decision_prompt
FROM p""",

    "summary_table": f"""
WITH {_SA}
SELECT ticker,
       CASE WHEN error IS NOT NULL THEN 'ERROR' ELSE '$' || coalesce(printf('%.2f', current_price), 'nan') END AS price,
       CASE WHEN error IS NOT NULL THEN '-'
            ELSE '$' || coalesce(printf('%.2f', change), 'nan') || ' ('
                 || coalesce(printf('%+.2f', percent_change), 'nan') || '%)' END AS change,
       CASE WHEN error IS NOT NULL THEN '-'
            WHEN news_alert OR news_score <> 0 THEN printf('%+.3f', news_score) ELSE '-' END AS news_score,
       CASE WHEN error IS NOT NULL THEN '-'
            ELSE coalesce(CASE avg_sentiment WHEN 'positive' THEN '+ Positive' WHEN 'negative' THEN '- Negative'
                                             WHEN 'neutral' THEN '~ Neutral' END, 'neutral') END AS sentiment,
       CASE WHEN error IS NOT NULL THEN '-' ELSE coalesce(printf('%.1f', rsi), 'nan') END AS rsi,
       CASE WHEN error IS NOT NULL THEN '-' ELSE coalesce(decision, 'HOLD') END AS decision,
       CASE WHEN error IS NOT NULL THEN '-' ELSE coalesce(confidence, 'LOW') END AS confidence,
       news_alert AS alert
FROM sa""",

    "detail_rows": f"""
WITH {_SA}
SELECT ticker,
       CASE WHEN error IS NOT NULL THEN 'Error: ' || error
            ELSE {render_sql(DETAIL, {"news_line": "(chr(10) || 'News: score=' || printf('%+.3f', news_score) || ' (' || upper(news_direction) || '), ' || CAST(news_count AS VARCHAR) || ' articles' || CASE WHEN news_alert THEN ' ALERT' ELSE '' END)", "analysis": f"coalesce({render_sql(ANALYSIS)}, 'N/A')"})}
       END AS detail
FROM sa""",
})


_STREAM_WINDOWS = """
WITH e AS (SELECT event_type AS ticker, ts, CAST((event_id * 37) % 201 - 100 AS DOUBLE) / 100.0 AS s FROM events),
k AS (SELECT ticker, ts, s, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * g AS window_start
      FROM e, range(0, 4) AS r(g)),
w AS (SELECT ticker, window_start, window_start + INTERVAL 1 HOUR AS window_end, s,
             CASE WHEN ts >= window_start + INTERVAL 45 MINUTE THEN 2.0 ELSE 1.0 END AS wt FROM k),
a AS (SELECT ticker, window_start, window_end, CAST(sum(CAST(s * wt AS DECIMAL(38,14))) AS DOUBLE) / sum(wt) AS raw, count(*) AS articles_count
      FROM w GROUP BY ALL),
m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM events),
x AS (SELECT a.* FROM a, m WHERE window_end <= wm)
SELECT ticker, window_start, window_end, round(raw, 4) AS score, round(raw, 6) AS raw_score,
       abs(raw) >= 0.7 AS alert, articles_count
FROM x"""

ORACLE.update({
    "stream_weighted": _STREAM_WINDOWS,
    "stream_alerts": f"SELECT * FROM ({_STREAM_WINDOWS}) AS y WHERE alert",
    "stream_dedup": """
WITH new AS (SELECT md5(text) AS url, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source,
                    arg_min(text, doc_id) AS headline
             FROM documents GROUP BY md5(text)),""" + _LEX_SCORE.replace(
        "scored AS (SELECT ticker, url, created_at, ec / (ea + eb + ec) - ea / (ea + eb + ec) AS sentiment_score",
        "scored AS (SELECT url, doc_id, source, round(ec / (ea + eb + ec) - ea / (ea + eb + ec), 6) AS sentiment_score") + """
SELECT * FROM scored""",
})



def _exact_round(sql: str) -> str:
    """Rewrite ``round(x, n)`` as ``CAST(printf('%.nf', x) AS DOUBLE)``: the
    exact binary value rounded half-to-even, as Python's ``round`` and the
    Spark side's ``py_round`` do (DuckDB's ``round`` scales and rounds in
    floating point and can land on the other side of a tie)."""
    out, i = [], 0
    pat = re.compile(r"(?<![A-Za-z0-9_])round\(")
    while True:
        m = pat.search(sql, i)
        if not m:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:m.start()])
        depth, j, comma = 1, m.end(), None
        while depth:
            ch = sql[j]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = j
            j += 1
        arg = _exact_round(sql[m.end():comma])
        digits = sql[comma + 1:j - 1].strip()
        out.append(f"(CAST(printf('%.{digits}f', {arg}) AS DOUBLE) + 0.0)")
        i = j


import re  # noqa: E402

ORACLE = {k: _exact_round(v) for k, v in ORACLE.items()}


ORACLE.update({
    "key_audit": """
SELECT l_partkey, l_shipdate, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) > 1""",

    "sentiment_rows": """
WITH t AS (SELECT doc_id, source, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS toks
           FROM documents),
n AS (SELECT doc_id, source, len(toks) AS n_tokens,
             len(list_filter(toks, lambda x: x IN ('and', 'with', 'und', 'et', 'for'))) AS n_pos,
             len(list_filter(toks, lambda x: x IN ('of', 'der', 'que', 'to', 'die'))) AS n_neg FROM t),
l AS (SELECT doc_id, source, CAST(100.0 AS DOUBLE) * n_neg / greatest(n_tokens, 1) AS a, CAST(1.0 AS DOUBLE) AS b,
             CAST(100.0 AS DOUBLE) * n_pos / greatest(n_tokens, 1) AS c FROM n),
e AS (SELECT *, exp(a - greatest(a, b, c)) AS ea, exp(b - greatest(a, b, c)) AS eb,
             exp(c - greatest(a, b, c)) AS ec FROM l),
p AS (SELECT *, ea / (ea + eb + ec) AS pn, eb / (ea + eb + ec) AS pu, ec / (ea + eb + ec) AS pp FROM e)
SELECT source AS ticker, doc_id,
       CASE WHEN pn >= pu AND pn >= pp THEN 'negative' WHEN pu >= pp THEN 'neutral' ELSE 'positive' END AS sentiment,
       round(greatest(pn, pu, pp), 4) AS score
FROM p""",

    "ledger_rows": f"""
WITH {_SA}
SELECT ticker, decision AS action, current_price AS price, 0 AS quantity,
       round(avg_score, 4) AS sentiment_avg, round(rsi, 4) AS rsi, round(macd, 4) AS macd, approved,
       nullif(concat_ws('; ',
         CASE WHEN length(ticker) > 10 THEN 'ticker longer than 10' END,
         CASE WHEN current_price IS NOT NULL AND TRY_CAST(current_price AS DECIMAL(12,4)) IS NULL
              THEN 'price overflows decimal(12,4)' END,
         CASE WHEN avg_score IS NOT NULL AND TRY_CAST(avg_score AS DECIMAL(6,4)) IS NULL
              THEN 'sentiment_avg overflows decimal(6,4)' END,
         CASE WHEN rsi IS NOT NULL AND TRY_CAST(rsi AS DECIMAL(6,2)) IS NULL THEN 'rsi overflows decimal(6,2)' END,
         CASE WHEN macd IS NOT NULL AND TRY_CAST(macd AS DECIMAL(12,4)) IS NULL
              THEN 'macd overflows decimal(12,4)' END), '') IS NULL AS valid,
       nullif(concat_ws('; ',
         CASE WHEN length(ticker) > 10 THEN 'ticker longer than 10' END,
         CASE WHEN current_price IS NOT NULL AND TRY_CAST(current_price AS DECIMAL(12,4)) IS NULL
              THEN 'price overflows decimal(12,4)' END,
         CASE WHEN avg_score IS NOT NULL AND TRY_CAST(avg_score AS DECIMAL(6,4)) IS NULL
              THEN 'sentiment_avg overflows decimal(6,4)' END,
         CASE WHEN rsi IS NOT NULL AND TRY_CAST(rsi AS DECIMAL(6,2)) IS NULL THEN 'rsi overflows decimal(6,2)' END,
         CASE WHEN macd IS NOT NULL AND TRY_CAST(macd AS DECIMAL(12,4)) IS NULL
              THEN 'macd overflows decimal(12,4)' END), '') AS reason
FROM sa WHERE error IS NULL""",

    "recent_news": """
WITH n AS (SELECT event_type AS ticker, event_id, ts AS created_at,
                  CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS published_at FROM events),
m AS (SELECT max(ts) AS as_of FROM events)
SELECT ticker, event_id,
       row_number() OVER (PARTITION BY ticker ORDER BY published_at DESC NULLS FIRST, event_id) AS rank
FROM n, m WHERE created_at >= as_of - INTERVAL 360 MINUTE""",
})
ORACLE = {k: _exact_round(v) for k, v in ORACLE.items()}


ORACLE.update({
    "decision_history_asof": """
WITH d AS (SELECT o_custkey, o_orderkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT'),
t AS (SELECT o_custkey, o_orderkey, o_orderdate FROM orders WHERE o_orderpriority <> '1-URGENT'),
j AS (SELECT d.o_orderkey AS dk, t.o_orderkey AS tk,
             row_number() OVER (PARTITION BY d.o_orderkey ORDER BY t.o_orderdate DESC, t.o_orderkey DESC) AS rn
      FROM d JOIN t ON t.o_custkey = d.o_custkey AND t.o_orderdate < d.o_orderdate)
SELECT d.o_orderkey,
       coalesce(string_agg(CAST(j.tk AS VARCHAR), ',' ORDER BY j.rn), '') AS history
FROM d LEFT JOIN j ON j.dk = d.o_orderkey AND j.rn <= 5
GROUP BY d.o_orderkey""",
})


ORACLE.update({
    "stream_bars": """
WITH m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM events),
b AS (SELECT event_type AS ticker, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS date,
             arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
             arg_max(value, (ts, event_id)) AS close, count(*) AS volume
      FROM events GROUP BY event_type, CAST(ts AS DATE))
SELECT b.* FROM b, m WHERE b.date + INTERVAL 1 DAY <= m.wm""",
})

# ---- the whole poll: one batch of every event and document

ORACLE["stream_pipeline"] = """
WITH m AS (SELECT max(ts) AS as_of FROM events),
u AS (SELECT DISTINCT source AS ticker FROM documents),
ev AS (SELECT 'src' || (user_id % 20) AS ticker, event_id, ts, value,
              CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
lq AS (SELECT ticker, arg_max(CASE WHEN k % 20 = 0 THEN CAST(0 AS DOUBLE) ELSE value END, (ts, event_id)) AS price FROM ev GROUP BY ticker),
q AS (SELECT * FROM lq WHERE price <> 0),
b AS (SELECT ticker, value, row_number() OVER w - 1 AS idx, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, event_id DESC) AS back,
             coalesce(value - lag(value) OVER w, 0) AS d
      FROM (SELECT ev.* FROM ev, m WHERE ts >= as_of - INTERVAL 1 MONTH) WINDOW w AS (PARTITION BY ticker ORDER BY ts, event_id)),
tech AS (SELECT ticker, CASE WHEN max(idx) < 13 THEN NULL WHEN sum(greatest(-d, 0)) FILTER (WHERE back <= 14) = 0
                             THEN CASE WHEN sum(greatest(d, 0)) FILTER (WHERE back <= 14) = 0 THEN NULL ELSE 100.0 END
                             ELSE 100.0 - 100.0 / (1.0 + sum(greatest(d, 0)) FILTER (WHERE back <= 14)
                                                         / sum(greatest(-d, 0)) FILTER (WHERE back <= 14)) END AS rsi
         FROM b GROUP BY ticker),
a AS (SELECT doc_id, source AS ticker, text AS headline, md5(text) AS url, as_of - INTERVAL (doc_id % 180) MINUTE AS created_at,
             lang = 'en' AND n_chars < 300 AS is_primary FROM documents, m),
feed AS (SELECT * FROM a WHERE is_primary
         UNION ALL SELECT * FROM a WHERE NOT is_primary AND ticker NOT IN (SELECT ticker FROM a WHERE is_primary)),
new AS (SELECT * FROM feed QUALIFY row_number() OVER (PARTITION BY url ORDER BY created_at, doc_id) = 1),""" + _LEX_SCORE + """,
w AS (SELECT ticker, sentiment_score AS sc, CASE WHEN created_at >= as_of - INTERVAL 15 MINUTE THEN 2.0 ELSE 1.0 END AS w
      FROM scored, m WHERE created_at >= as_of - INTERVAL 60 MINUTE),
agg AS (SELECT ticker, CAST(sum(CAST(sc * w AS DECIMAL(38,14))) AS DOUBLE) / nullif(sum(w), 0) AS raw, count(*) AS n FROM w GROUP BY ticker),
kept AS (SELECT ticker, count(*) AS articles FROM new GROUP BY ticker),
heads AS (SELECT ticker, list_filter(regexp_split_to_array(lower(headline), '[^a-z]+'), lambda x: x <> '') AS toks FROM a
          WHERE length(headline) > 0 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY created_at DESC, doc_id DESC) <= 10),
logits AS (SELECT ticker, 100.0 * len(list_filter(toks, lambda x: x IN ('of', 'der', 'que', 'to', 'die'))) / greatest(len(toks), 1) AS neg,
                  100.0 * len(list_filter(toks, lambda x: x IN ('and', 'with', 'und', 'et', 'for'))) / greatest(len(toks), 1) AS pos FROM heads),
net AS (SELECT ticker, CAST(count(*) FILTER (WHERE pos > 1.0 AND pos > neg) - count(*) FILTER (WHERE neg >= 1.0 AND neg >= pos) AS DOUBLE)
                       / count(*) AS score FROM logits GROUP BY ticker),
j AS (SELECT u.ticker, q.price, CASE WHEN coalesce(n, 0) > 0 THEN round(raw, 4) ELSE coalesce(net.score, 0.0) END AS path_score, coalesce(kept.articles, 0) AS articles, coalesce(raw, 0.0) AS raw, coalesce(n, 0) AS n, tech.rsi,
             CASE WHEN q.price IS NULL THEN 'Failed to fetch market data for ' || u.ticker
                  WHEN tech.ticker IS NULL THEN 'No price history available for technical analysis' END AS error
      FROM u LEFT JOIN q ON q.ticker = u.ticker LEFT JOIN kept ON kept.ticker = u.ticker LEFT JOIN agg ON agg.ticker = u.ticker
      LEFT JOIN tech ON tech.ticker = u.ticker LEFT JOIN net ON net.ticker = u.ticker)
SELECT ticker, price AS quote, articles, round(raw, 4) AS news_score, abs(raw) >= 0.7 AS news_alert, n AS news_count,
       CASE WHEN price IS NOT NULL THEN CASE WHEN n > 0 THEN 'news_engine' ELSE 'headlines' END END AS sentiment_source,
       CASE WHEN price IS NOT NULL THEN CASE WHEN path_score > 0.2 THEN 'positive' WHEN path_score < -0.2 THEN 'negative' ELSE 'neutral' END END
         AS avg_sentiment,
       CASE WHEN error IS NULL THEN 'HOLD' END AS action, CASE WHEN error IS NULL THEN price END AS trade_price,
       CASE WHEN error IS NULL THEN round(rsi, 2) END AS rsi, error
FROM j"""


_FEED = r"""i AS (SELECT source AS ticker, CAST(floor(doc_id / 480) AS BIGINT) AS batch, lang = 'en' AS prim, doc_id,
                  TIMESTAMP '2024-01-01' + to_seconds(doc_id * 61) AS moment,
                  CASE WHEN doc_id % 13 = 0 THEN '' ELSE
                    regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]', ' ', 'g')
                    || CASE WHEN doc_id % 3 = 0 THEN ' - Reuters' ELSE '' END END AS title,
                  CASE WHEN doc_id % 7 <> 0 THEN 'https://news.example/?a=1&id=' || doc_id END AS link FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY ticker, batch, prim ORDER BY doc_id) - 1 AS pos,
             TIMESTAMP '2024-01-01' + to_hours(batch) AS fetched_at FROM i QUALIFY pos < 10)"""

ORACLE["landed_feeds"] = f"""
WITH {_FEED},
h AS (SELECT *, {_clean('title')} AS headline FROM f)
SELECT ticker, fetched_at, pos, md5(headline) AS headline_md5, coalesce(link, '') AS url,
       CASE WHEN prim AND doc_id % 8 = 0 THEN NULL WHEN NOT prim AND doc_id % 11 = 0 THEN NULL ELSE moment END AS published_at,
       CASE WHEN prim THEN 'yfinance' ELSE 'google_news' END AS source
FROM h WHERE NOT prim OR (headline <> '' AND link IS NOT NULL)"""

ORACLE["landed_headlines"] = f"""
WITH {_FEED}
SELECT ticker, fetched_at, count(*) AS n, md5(string_agg(md5(title), ',' ORDER BY pos)) AS headlines_md5
FROM f WHERE prim AND title <> '' GROUP BY ticker, fetched_at"""

ORACLE["url_index_dedup"] = ORACLE["url_dedup"]
