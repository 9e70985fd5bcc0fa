"""Queries bound to the landed tables, one per operator family.

Each query reads whole tables (``sf_dir/<name>.parquet``) and returns a lazy
DataFrame.  Where the test tables lack a field the reference works on (URLs,
publisher suffixes, model replies), it is derived with plain expressions that
the DuckDB oracle in ``oracle.py`` repeats.  Floating results that two engines
compute in different operation orders are rounded (4 places) on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketsig.functions import scalar as X
from marketsig.functions.text import clean_headline
from marketsig.functions.text import parse_decision as _parse
from marketsig.operators import indicators as ind
from marketsig.operators import keys, sentiment, snapshots, topk, url_index, validate, wide
from marketsig.plans import news as news_plan
from marketsig.plans import poll
from marketsig.plans import prompts as prompt_plan
from marketsig.plans.prompts import history_context, history_line
from marketsig.plans import report
from marketsig.plans import signals as sig
from marketsig.schemas import MARKET_QUOTES, NEWS_STAGING, TRADE_LEDGER
from marketsig.sources import bars
from marketsig.sources import news as feeds
from marketsig.sources import quotes
from marketsig.sources.news import PRIMARY, SECONDARY
from marketsig.sources.tables import newest, table
from marketsig.streaming import monitor as stream_ops

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _day(c: str):
    """A bar's day as a midnight TIMESTAMP_NTZ (same type in every engine)."""
    return F.col(c).cast("timestamp_ntz").alias(c)


def _events(spark, sf):
    return table(spark, sf, "events")


# ------------------------------------------------------------ indicators

@query
def rsi_14(spark: SparkSession, sf: str) -> DataFrame:
    """RSI(14) on every event of every user series (price = value)."""
    ev = _events(spark, sf).select("user_id", "ts", "event_id", "value")
    d = ind.with_position(ev, "user_id", "ts", "event_id")
    d = ind.rsi(d, "user_id", "value", 14, out="rsi_14")
    return d.select("user_id", "event_id", X.py_round("rsi_14", 4).alias("rsi_14"))


@query
def ema_macd(spark: SparkSession, sf: str) -> DataFrame:
    """MACD(12, 26, 9) on every event of every user series."""
    ev = _events(spark, sf).select("user_id", "ts", "event_id", "value")
    d = ind.with_position(ev, "user_id", "ts", "event_id")
    d = ind.macd(d, "user_id", "value")
    return d.select("user_id", "event_id", X.py_round("macd", 4).alias("macd"),
                    X.py_round("signal", 4).alias("signal"), X.py_round("histogram", 4).alias("histogram"))


@query
def price_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Change from the previous event of the same user."""
    ev = _events(spark, sf).select("user_id", "ts", "event_id", "value")
    d = ind.with_position(ev, "user_id", "ts", "event_id")
    return ind.price_delta(d, "user_id", "value").select("user_id", "event_id", "delta")


@query
def rolling_mean(spark: SparkSession, sf: str) -> DataFrame:
    """14-row rolling mean, NULL until 14 rows exist."""
    ev = _events(spark, sf).select("user_id", "ts", "event_id", "value")
    d = ind.with_position(ev, "user_id", "ts", "event_id")
    d = ind.rolling_mean(d, "user_id", "value", 14, "mean_14")
    return d.select("user_id", "event_id", X.py_round("mean_14", 4).alias("mean_14"))


@query
def ohlcv_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars per event type (ticker) from the event ticks."""
    ev = _events(spark, sf)
    b = bars.daily_bars(ev, "event_type", "ts", "value", "event_id")
    return b.select(F.col("event_type").alias("ticker"), _day("date"), "open", "high", "low",
                    "close", "volume")


@query
def lookback_1mo(spark: SparkSession, sf: str) -> DataFrame:
    """The one-month look-back slice, as of the newest order."""
    o = table(spark, sf, "orders")
    as_of = newest(o, "o_orderdate")
    return (bars.lookback(o, "o_orderdate", as_of, 1)
            .select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"))


@query
def indicators_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Indicators of each ticker's daily bars at its last day,
    with the rule-based reading."""
    b = bars.daily_bars(_events(spark, sf), "event_type", "ts", "value", "event_id")
    last = ind.interpret(ind.latest_indicators(b, "event_type", "date", "close", block_unit="year"))
    return last.select(F.col("event_type").alias("ticker"), _day("date"), "close",
                       X.py_round("rsi", 4).alias("rsi"), X.py_round("macd", 4).alias("macd"),
                       X.py_round("signal", 4).alias("signal"), X.py_round("histogram", 4).alias("histogram"),
                       "rsi_zone", "macd_trend", "momentum", "outlook")


# ------------------------------------------------------------ sources, keys



def _k(ev):
    return F.get_json_object("props", "$.k").try_cast("int")


@query
def quotes_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Quote payloads landed as JSON text (built from each event:
    price = value, zero when props.k = 0), decoded with a fixed schema; zero
    prices are dropped."""
    ev = _events(spark, sf)
    k = _k(ev).cast("double")
    payload = F.to_json(F.struct(
        F.when(k == 0, F.lit(0.0)).otherwise(F.col("value")).alias("c"),
        ((k - 50.0) / F.lit(10.0)).alias("d"),
        ((k - 50.0) / F.lit(4.0)).alias("dp"),
        (F.col("value") + k / F.lit(100.0)).alias("h"),
        (F.col("value") - k / F.lit(100.0)).alias("l"),
        (F.col("value") - (k - 50.0) / F.lit(20.0)).alias("o"),
        (F.col("value") - (k - 50.0) / F.lit(10.0)).alias("pc")))
    landed = ev.select("event_id", F.col("event_type").alias("ticker"), payload.alias("payload"))
    return quotes.decode(landed)


# The universe used by the universe query (upper-cased event types).
UNIVERSE = ["CLICK", "PURCHASE", "VIEW"]


@query
def universe_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose upper-cased type is in the universe list."""
    ev = _events(spark, sf).select("event_id", "user_id", "event_type", "value")
    kept = keys.in_universe(ev, "event_type", UNIVERSE)
    return kept.select("event_id", "user_id", F.upper("event_type").alias("ticker"), "value")


def _feeds(spark, sf):
    d = table(spark, sf, "documents")
    is_primary = (F.col("lang") == "en") & (F.col("n_chars") < 300)
    primary = d.filter(is_primary).withColumn("feed", F.lit("primary"))
    secondary = d.filter(~is_primary).withColumn("feed", F.lit("secondary"))
    return primary, secondary


@query
def source_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Per source (ticker), the primary feed (short English documents)
    if it has any rows, else the secondary feed (everything else)."""
    p, s = _feeds(spark, sf)
    cols = ["source", "doc_id", "feed"]
    return keys.fallback(p.select(*cols), s.select(*cols), "source")


@query
def news_first_n(spark: SparkSession, sf: str) -> DataFrame:
    """The first 10 documents of each source in doc_id order,
    then those with short text (under 100 characters) dropped."""
    d = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    first = topk.top_k_per_key(d, "source", [F.col("doc_id")], 10, rank="pos")
    return (first.filter(F.col("n_chars") >= 100)
            .select("source", (F.col("pos") - 1).cast("long").alias("pos"), "doc_id", "n_chars"))


@query
def headline_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Per source the ids of its first-10 kept documents, in feed order."""
    kept = news_first_n(spark, sf)
    return (kept.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("pos", "doc_id"))).alias("_h"))
            .select("source", F.array_join(F.transform("_h", lambda x: x["doc_id"].cast("string")), ",")
                    .alias("doc_ids")))


@query
def url_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Insert-ignore on the URL (md5 of the whole text stands in
    for it): first doc_id per URL, minus URLs already stored (the German
    documents play the stored table)."""
    d = table(spark, sf, "documents")
    incoming = d.select(F.md5("text").alias("url"), "doc_id", "source")
    existing = d.filter(F.col("lang") == "de").select(F.md5("text").alias("url"))
    return keys.insert_ignore(incoming, existing, "url", ["doc_id"])


@query
def quote_insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    """Insert-ignore on (ticker, timestamp) = (l_partkey, l_shipdate);
    stored rows are the returned items (flag R), the batch is the rest; first
    row per key by (l_orderkey, l_linenumber)."""
    li = table(spark, sf, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber",
                                             "l_extendedprice", "l_returnflag")
    stored = li.filter(F.col("l_returnflag") == "R")
    batch = li.filter(F.col("l_returnflag") != "R").drop("l_returnflag")
    return keys.insert_ignore(batch, stored, ["l_partkey", "l_shipdate"], ["l_orderkey", "l_linenumber"])


@query
def score_update(spark: SparkSession, sf: str) -> DataFrame:
    """Set each document's stored score from its label where one
    exists (quality - toxic), keep the old score otherwise."""
    d = table(spark, sf, "documents").select(
        "doc_id", "lang",
        F.when(F.col("lang") == "en", F.lit(0.1)).when(F.col("lang") == "fr", F.lit(-0.1))
        .cast("double").alias("sentiment_score"))
    upd = table(spark, sf, "labels").select(
        "doc_id", (F.col("quality") - F.col("toxic")).cast("double").alias("sentiment_score"))
    return keys.apply_updates(d, upd, "doc_id", "sentiment_score")


def order_ledger_rows(orders: DataFrame) -> DataFrame:
    """Orders as trade-ledger rows (P4 shape): status P/F/O -> BUY/SELL/HOLD,
    except low-priority open orders, which carry the invalid action WAIT."""
    o = orders
    action = (F.when(F.col("o_orderstatus") == "P", "BUY").when(F.col("o_orderstatus") == "F", "SELL")
              .when(F.col("o_orderpriority") == "5-LOW", "WAIT").otherwise("HOLD"))
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("ticker"), action.alias("action"),
        (F.col("o_totalprice") * 250.0).alias("price"), F.lit(0).alias("quantity"),
        F.lit("order").alias("reasoning"),
        ((F.col("o_totalprice") % 200.0 - 100.0) / 100.0).alias("sentiment_avg"),
        (F.col("o_totalprice") / 5000.0).alias("rsi"), F.lit(None).cast("double").alias("macd"),
        action.isin("BUY", "SELL").alias("approved"), F.lit("").alias("portfolio_manager_reasoning"),
        F.when((F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderstatus") == "F"), F.lit(None))
        .otherwise(F.col("o_orderdate")).alias("timestamp"))


@query
def validate_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Every ledger row checked against the ledger's
    constraints; ``reason`` lists all failed checks."""
    rows = order_ledger_rows(table(spark, sf, "orders"))
    return validate.check(rows, TRADE_LEDGER).select("id", "valid", "reason")


def _raw_titles(spark, sf):
    p = table(spark, sf, "pages")
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    raw = (F.when(F.col("page_id") % 3 == 0, F.concat(title, F.lit(" - Reuters")))
           .when(F.col("page_id") % 3 == 1, F.concat(F.lit("<b>"), title, F.lit("</b>")))
           .otherwise(F.concat(title, F.lit(" | Bloomberg News"))))
    return p.select("page_id", raw.alias("raw_headline"))


@query
def clean_headlines(spark: SparkSession, sf: str) -> DataFrame:
    """Page titles with a publisher suffix or a tag added, cleaned."""
    t = _raw_titles(spark, sf)
    return t.select("page_id", "raw_headline", clean_headline("raw_headline").alias("headline"))


@query
def timestamps(spark: SparkSession, sf: str) -> DataFrame:
    """Epoch fields with 0 / missing values, falsy-coalesced and
    converted; RSS dates rendered and parsed back; ingest-else-publish time."""
    ev = _events(spark, sf).select("event_id", "ts")
    secs = X.epoch_seconds("ts")
    eid = F.col("event_id")
    pt = F.when(eid % 4 == 0, F.lit(0).cast("long")).otherwise(secs)
    pa = F.when(eid % 5 == 0, F.lit(None).cast("long")).otherwise(secs + 30)
    link = F.when(eid % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("https://news.example/"), eid))
    url = F.concat(F.lit("https://feed.example/"), eid)
    published = X.from_epoch(X.falsy_coalesce(pt, pa))
    created = F.when(eid % 2 == 0, F.col("ts"))
    return ev.select(
        "event_id", published.alias("published_at"), X.falsy_coalesce(link, url, empty="").alias("url"),
        X.rss_to_timestamp(X.rss_format("ts")).alias("rss_published"),
        X.seen_at(created, published).alias("seen_at"))


@query
def softmax_label(spark: SparkSession, sf: str) -> DataFrame:
    """Every third embedding dimension summed into one class's logit ->
    probabilities, label (ties to the first class), confidence, signed score."""
    def logit(cls: int):
        own = F.filter("embedding", lambda x, i: i % 3 == cls)
        return F.aggregate(own, F.lit(0.0), lambda total, x: total + x.cast("double"))

    d = sentiment.classify(table(spark, sf, "embeddings"), *[logit(cls) for cls in range(3)])
    r = lambda c: X.py_round(c, 6).alias(c)
    return d.select("vec_id", r("p_negative"), r("p_neutral"), r("p_positive"), "sentiment",
                    r("confidence"), r("score"))


# The word list the lexicon query scores the test documents with
# (frequent words of the generated prose, split arbitrarily into two classes).
TEST_LEXICON = {
    "and": "positive", "with": "positive", "und": "positive", "et": "positive", "for": "positive",
    "of": "negative", "der": "negative", "que": "negative", "to": "negative", "die": "negative",
}


@query
def lexicon_score(spark: SparkSession, sf: str) -> DataFrame:
    """E1 (default scorer): lexicon hits over each whole document -> logits
    -> probabilities and signed score."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    c = sentiment.lexicon_counts(d, "text", TEST_LEXICON)
    s = sentiment.classify(c, *sentiment.lexicon_logits())
    r = lambda x: X.py_round(x, 6).alias(x)
    n = lambda x: F.col(x).cast("long").alias(x)
    return s.select("doc_id", n("n_tokens"), n("n_pos"), n("n_neg"), r("p_negative"), r("p_neutral"),
                    r("p_positive"), "sentiment", r("score"))


def _label_class():
    return (F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive")
            .otherwise("neutral"))


@query
def net_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    """Count-path sentiment per ticker (source:lang) from labelled
    documents; tickers without labels get the neutral zero row."""
    d = table(spark, sf, "documents").select("doc_id", F.concat_ws(":", "source", "lang").alias("ticker"))
    scored = d.join(table(spark, sf, "labels"), "doc_id").select("ticker", _label_class().alias("sentiment"))
    universe = d.select("ticker").distinct()
    return sentiment.count_path(scored, "ticker", universe=universe)


def _event_scores(spark, sf):
    ev = _events(spark, sf)
    score = ((F.col("event_id") * 37) % 201 - 100) / F.lit(100.0)
    return ev.select(F.col("event_type").alias("ticker"), F.col("user_id"), F.col("event_id"),
                     F.col("ts").alias("created_at"), score.alias("sentiment_score"))


@query
def weighted_score(spark: SparkSession, sf: str) -> DataFrame:
    """Recency-weighted score per ticker as of the newest event
    (look-back widened to 3 days, double weight for the last 12 hours)."""
    ev = _events(spark, sf)
    news = _event_scores(spark, sf)
    as_of = newest(ev, "ts")
    a = sentiment.weighted_scores(news, as_of, "ticker", "created_at", "sentiment_score",
                                  lookback_minutes=3 * 24 * 60, recent_minutes=12 * 60)
    a = sentiment.from_alert(a)
    return a.select("ticker", "score", X.py_round("raw_score", 6).alias("raw_score"), "alert",
                    "articles_count", "direction", "avg_sentiment", "positive_ratio",
                    "negative_ratio", "neutral_ratio")


# ------------------------------------------------------------ top-k, history, replies



def _desc(*cols):
    return [F.col(c).desc() for c in cols]


@query
def topk_trades(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's 5 newest orders (ties: larger key first)."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    t = topk.top_k_per_key(o, "o_custkey", _desc("o_orderdate", "o_orderkey"), 5)
    return t.withColumn("rank", F.col("rank").cast("long"))


@query
def topk_all(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 newest orders overall."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return topk.top_k(o, _desc("o_orderdate", "o_orderkey"), 20)


@query
def topk_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier's 10 newest line items."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate")
    t = topk.top_k_per_key(li, "l_suppkey", _desc("l_shipdate", "l_orderkey", "l_linenumber"), 10)
    return t.withColumn("rank", F.col("rank").cast("long"))


def order_trades(orders: DataFrame) -> DataFrame:
    """Orders read as past trades of ticker C<custkey>."""
    act = (F.when(F.col("o_orderstatus") == "P", "BUY").when(F.col("o_orderstatus") == "F", "SELL")
           .otherwise("HOLD"))
    return orders.select(
        F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderdate").alias("timestamp"), act.alias("action"),
        F.col("o_totalprice").alias("price"),
        ((F.col("o_totalprice") % 200.0 - 100.0) / 101.0).alias("sentiment_avg"),
        (F.col("o_totalprice") / 5003.0).alias("rsi"), F.col("o_orderpriority").alias("reasoning"))


@query
def trade_history_asof(spark: SparkSession, sf: str) -> DataFrame:
    """J3 (+E6 history block): for every order, the customer's 5 previous
    orders newest first, rendered as the decision prompt's history lines."""
    t = order_trades(table(spark, sf, "orders"))
    t = t.select("o_custkey", "o_orderkey", "timestamp",
                 history_line("timestamp", "action", "price", "sentiment_avg", "rsi", "reasoning").alias("line"))
    h = topk.history_before(t, "o_custkey", "timestamp", "o_orderkey", 5, ["line"])
    h = h.withColumn("history", F.transform("history", lambda x: x["line"]))
    return h.select("o_custkey", "o_orderkey", history_context("history").alias("history_context"))


# Decision lines used to build test replies, one per conv_id mod 7
# (well-formed, lower-case, markdown-wrapped, bracketed, missing, repeated).
REPLY_LINES = [
    "DECISION: BUY\nCONFIDENCE: HIGH",
    "decision: sell\nconfidence: medium",
    "**DECISION:** BUY",
    "DECISION: [SELL]",
    "DECISION: hold\nCONFIDENCE: LOW",
    "",
    "Decision:BUY Decision: SELL\nConfidence:high",
]


def _replies(spark, sf):
    c = table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    line = F.element_at(F.array(*[F.lit(x) for x in REPLY_LINES]), (F.col("conv_id") % 7 + 1).cast("int"))
    think = F.when(F.col("turn") % 3 == 0, F.lit("")).otherwise(
        F.concat(F.lit("<think>"), F.col("text"), F.lit("</think>\n")))
    reply = F.concat(think, line, F.lit("\nREASONING: "), F.col("text"))
    return c.select("conv_id", "turn", reply.alias("reply"))


@query
def parse_decision(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns made into model replies (think block,
    decision line by conv_id mod 7, reasoning) and parsed."""
    r = _replies(spark, sf).withColumn("d", _parse("reply"))
    return r.select("conv_id", "turn", "d.decision", "d.confidence", "d.reasoning", "d.thinking_process",
                    "d.approved")


# ------------------------------------------------------------ end-to-end plans


NEWS_LOOKBACK_MINUTES = 24 * 60
NEWS_RECENT_MINUTES = 6 * 60


_lexicon_scorer = sentiment.lexicon_scorer("headline", TEST_LEXICON)


@query
def news_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Documents arrive as news (ticker = source, URL = md5 of the whole
    text, ingest time = the event with the same id); German documents are the
    stored table (score from labels, NULL = never scored).  Fallback, URL
    insert-ignore, lexicon scoring of new rows only, weighted score per ticker
    (look-back widened to 24 h, double weight for the last 6 h)."""
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    ev = _events(spark, sf).select(F.col("event_id").alias("doc_id"), F.col("ts").alias("created_at"))
    arts = d.join(ev, "doc_id", "left").select(
        F.col("source").alias("ticker"), F.md5("text").alias("url"), F.col("text").alias("headline"),
        "created_at", F.lit(None).cast("timestamp_ntz").alias("published_at"), F.col("doc_id").alias("pos"),
        "doc_id", "lang", "n_chars")
    is_p = (F.col("lang") == "en") & (F.col("n_chars") < 300)
    labels = table(spark, sf, "labels").select(
        "doc_id", (F.col("quality") - F.col("toxic")).cast("double").alias("sentiment_score"))
    existing = (arts.filter(F.col("lang") == "de").join(labels, "doc_id", "left")
                .select("ticker", "url", "headline", "created_at", "published_at", "sentiment_score"))
    as_of = newest(arts, "created_at")
    universe = d.select(F.col("source").alias("ticker")).distinct()
    signals, _ = news_plan.news_signals(arts.filter(is_p), arts.filter(~is_p), existing, _lexicon_scorer,
                                        as_of, universe, "ticker", ("created_at", "pos"),
                                        NEWS_LOOKBACK_MINUTES, NEWS_RECENT_MINUTES)
    return signals.select("ticker", "score", X.py_round("raw_score", 6).alias("raw_score"), "alert",
                          F.col("articles_count").cast("long").alias("articles_count"), "direction")


# How the assembly binding labels a user's recent event scores
# for the count path.
HEADLINE_POS, HEADLINE_NEG = 0.33, -0.33


def _user_ticker():
    return F.concat(F.lit("U"), F.col("user_id").cast("string"))


def _signal_inputs(spark, sf):
    ev = _events(spark, sf)
    as_of = newest(ev, "ts")
    rows = ev.select(_user_ticker().alias("ticker"), "ts", "event_id", "value", "props",
                     (((F.col("event_id") * 37) % 201 - 100) / F.lit(100.0)).alias("sentiment_score"))

    def label(s):
        return F.when(s > HEADLINE_POS, "positive").when(s < HEADLINE_NEG, "negative").otherwise("neutral")

    # every event is a quote, a bar and a scored headline of its user
    w = wide.wide_state(rows, as_of, "ticker", "ts", "event_id", "value", "sentiment_score", ["value", "props"], label=label,
                        lookback_minutes=NEWS_LOOKBACK_MINUTES, recent_minutes=NEWS_RECENT_MINUTES)
    # the JSON payload is built for the one newest row per ticker, not for every event
    k = _k(w).cast("double")
    payload = F.to_json(F.struct(
        F.when(k % 20 == 0, F.lit(0.0)).otherwise(F.col("value")).alias("c"),
        ((k - 50.0) / F.lit(10.0)).alias("d"), ((k - 50.0) / F.lit(4.0)).alias("dp"),
        (F.col("value") + k / F.lit(100.0)).alias("h"), (F.col("value") - k / F.lit(100.0)).alias("l"),
        (F.col("value") - (k - 50.0) / F.lit(20.0)).alias("o"),
        (F.col("value") - (k - 50.0) / F.lit(10.0)).alias("pc")))
    rep = _replies(spark, sf)
    rep = ind.latest(rep, "conv_id", "turn").select(
        F.concat(F.lit("U"), F.col("conv_id").cast("string")).alias("ticker"), "reply")
    return sig.assemble_wide(w.withColumn("payload", payload), rep, "ticker")


@query
def signal_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """Every user is a ticker; quote = its newest event
    (price 0 when props.k is a multiple of 20 -> no quote -> error), history
    = its events of the last month, news = weighted event scores, count path
    = its 10 newest event scores, decision = the conversation with its id."""
    a = _signal_inputs(spark, sf)
    r4 = lambda c: X.py_round(c, 4).alias(c)
    return a.select("ticker", "news_score", "news_alert", "news_count", "news_direction", "current_price",
                    "change", "percent_change", "high", "low", "previous_close", "avg_sentiment", "avg_score", "positive_ratio",
                    "negative_ratio", "neutral_ratio", "total_headlines", "sentiment_source",
                    r4("rsi"), r4("macd"), r4("signal"), r4("histogram"), "rsi_zone", "macd_trend",
                    "momentum", "outlook", "decision", "confidence", "reasoning", "approved", "error")




def _assembled(spark, sf):
    """The assembly with indicators rounded to 4 places (what the report and
    prompt queries format)."""
    return signal_assembly(spark, sf)


@query
def prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Technical and decision prompts for every ticker
    without an error."""
    return prompt_plan.prompt_table(_assembled(spark, sf))


@query
def summary_table(spark: SparkSession, sf: str) -> DataFrame:
    """P5: the summary table's eight text cells per ticker."""
    return report.summary_table(_assembled(spark, sf))


@query
def detail_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One detail text per ticker."""
    return report.detail_rows(_assembled(spark, sf))


# ------------------------------------------------------------ streaming



def _table_stream(spark, sf, name):
    """A file stream over one landed table of the folder, a file or a folder of files.  The name is
    given as a pattern: without one, Spark takes the path of a stream for a folder."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _stream_scores(spark, sf):
    s = _table_stream(spark, sf, "events")
    s = s.select(F.col("event_type").alias("ticker"), "ts",
                 (((F.col("event_id") * 37) % 201 - 100) / F.lit(100.0)).alias("sentiment_score"))
    s = stream_ops.event_time(s, "ts")
    scores = stream_ops.sliding_scores(s, "ticker", "event_time", "sentiment_score")
    out = stream_ops.run_to_table(scores, spark, "stream-weighted")
    return out.select("ticker", stream_ops.wall_clock(F.col("window.start")).alias("window_start"),
                      stream_ops.wall_clock(F.col("window.end")).alias("window_end"), "score",
                      X.py_round("raw_score", 6).alias("raw_score"), "alert", "articles_count")


@query
def stream_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """The event stream's weighted score per ticker in 1-hour
    windows sliding by 15 minutes (watermark 10 minutes, availableNow);
    closed windows only."""
    return _stream_scores(spark, sf)


@query
def stream_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """The windows of ``stream_weighted`` that raised an alert."""
    return _stream_scores(spark, sf).filter(F.col("alert"))


@query
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as a stream, exact URL insert-ignore per
    micro-batch against the stored table, only new rows scored."""
    s = _table_stream(spark, sf, "documents").select(
        F.md5("text").alias("url"), "doc_id", "source", F.col("text").alias("headline"))
    path = stream_ops.scratch_path(spark, "news-table")

    def score(df):
        return _lexicon_scorer(df).select("url", "doc_id", "source",
                                          X.py_round("sentiment_score", 6).alias("sentiment_score"))
    q = stream_ops.insert_new_articles(s, path, score, "url", ["doc_id"],
                                       checkpoint=stream_ops.scratch_path(spark, "ckpt-dedup"))
    q.awaitTermination()
    return spark.read.parquet(path).drop("batch_id")


# ------------------------------------------------------------ audits, ledger, rows



@query
def key_audit(spark: SparkSession, sf: str) -> DataFrame:
    """C3/C4 audit: (ticker, timestamp) keys = (l_partkey, l_shipdate) that
    occur more than once."""
    li = table(spark, sf, "lineitem").select("l_partkey", "l_shipdate")
    return keys.duplicate_keys(li, ["l_partkey", "l_shipdate"])


@query
def sentiment_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every document scored as a headline of its source;
    the stored score is the winning class's confidence (4 places)."""
    d = table(spark, sf, "documents").select("doc_id", "source", "text")
    c = sentiment.lexicon_counts(d, "text", TEST_LEXICON)
    s = sentiment.classify(c, *sentiment.lexicon_logits())
    rows = sentiment.sentiment_rows(s.withColumn("headline", F.col("doc_id")), "source", "headline",
                                    F.lit(None).cast("timestamp_ntz"))
    return rows.select("ticker", F.col("headline").alias("doc_id"), "sentiment",
                       X.py_round("score", 4).alias("score"))


@query
def ledger_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger row of every ticker without an error (quantity
    0, price = quote, sentiment = chosen path's score), checked against the
    ledger's constraints."""
    a = _signal_inputs(spark, sf)
    as_of = newest(_events(spark, sf), "ts")
    led = sig.ledger_rows(a, as_of)
    return validate.check(led, TRADE_LEDGER).select("ticker", "action", "price", "quantity",
                                             X.py_round("sentiment_avg", 4).alias("sentiment_avg"),
                                             X.py_round("rsi", 4).alias("rsi"),
                                             X.py_round("macd", 4).alias("macd"), "approved", "valid",
                                             "reason")


@query
def recent_news(spark: SparkSession, sf: str) -> DataFrame:
    """Each ticker's scored events of the last 6 hours before
    the newest one, ranked newest-published first with missing publish times
    (every 7th event) first."""
    n = _event_scores(spark, sf).withColumn(
        "published_at", F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("created_at")))
    as_of = newest(_events(spark, sf), "ts")
    r = sentiment.recent_news(n, as_of, "ticker", "created_at", hours=6, tie="event_id")
    return r.select("ticker", "event_id", "rank")


@query
def decision_history_asof(spark: SparkSession, sf: str) -> DataFrame:
    """J3 back-fill: urgent orders play decisions, the other orders trades;
    each decision gets the keys of its customer's 5 latest trades strictly
    before its date, newest first."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    h = topk.history_asof(o.filter(urgent).drop("o_orderpriority"), o.filter(~urgent).drop("o_orderpriority"),
                          "o_custkey", "o_orderdate", "o_orderkey", "o_orderkey", 5, ["o_orderkey"])
    return h.select("o_orderkey", F.array_join(F.transform("history", lambda x: x["o_orderkey"].cast("string")), ",")
                    .alias("history"))


@query
def stream_bars(spark: SparkSession, sf: str) -> DataFrame:
    """S7 on a stream: daily bars per event type from the event stream
    (watermark 10 minutes, availableNow); closed days only."""
    s = stream_ops.event_time(_table_stream(spark, sf, "events"), "ts")
    out = stream_ops.run_to_table(stream_ops.daily_bars_stream(s, "event_type", "event_time", "value", "event_id"),
                                  spark, "stream-bars")
    return out.select(F.col("event_type").alias("ticker"), stream_ops.wall_clock(F.col("day.start")).alias("date"),
                      "open", "high", "low", "close", "volume")


# ------------------------------------------------------------ the whole poll


def _landed_stream(spark, sf):
    """Events as quotes of 20 tickers, documents as their news (published over the last three hours), in one stream."""
    newest_ts = newest(_events(spark, sf), "ts")
    none = lambda t: F.lit(None).cast(t)
    ev = _table_stream(spark, sf, "events")
    quote = F.to_json(F.struct(F.when(_k(ev) % 20 == 0, F.lit(0.0)).otherwise(F.col("value")).alias("c"),
                               *[(F.col("value") / F.lit(float(i + 2))).alias(c) for i, c in enumerate(("d", "dp", "h", "l", "o", "pc"))]))
    ev = stream_ops.event_time(ev.withColumn("payload", quote), "ts", "at").select(
        F.lit("quote").alias("kind"), _source_of("user_id").alias("ticker"), "at", F.col("event_id").alias("n"), "payload",
        none("string").alias("headline"), none("string").alias("url"), none("timestamp").alias("published_at"), none("string").alias("source"))
    docs = _table_stream(spark, sf, "documents").withColumn(
        "ts", F.timestamp_add("MINUTE", -(F.col("doc_id") % 180), X.time_literal(newest_ts)))
    docs = stream_ops.event_time(docs, "ts", "at").select(
        F.lit("news").alias("kind"), F.col("source").alias("ticker"), "at", F.col("doc_id").alias("n"), none("string").alias("payload"),
        F.col("text").alias("headline"), F.md5("text").alias("url"), none("timestamp").alias("published_at"),
        F.when((F.col("lang") == "en") & (F.col("n_chars") < 300), PRIMARY).otherwise(SECONDARY).alias("source"))
    return ev.unionByName(docs)


def _source_of(user_id: str):
    return F.concat(F.lit("src"), (F.col(user_id) % 20).cast("string"))


@query
def stream_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Every landed event and document through the streaming poll; per ticker what the
    published snapshot holds: its quote, articles, news signal, sentiment path and trade."""
    root = stream_ops.scratch_path(spark, "poll")
    universe = table(spark, sf, "documents").select(F.col("source").alias("ticker")).distinct()

    def history(as_of):
        bars_ = stream_ops.event_time(_events(spark, sf), "ts", "at").select(
            _source_of("user_id").alias("ticker"), F.col("at").alias("ts"), F.col("event_id").alias("n"), F.col("value").alias("price"))
        return bars.lookback(bars_, "ts", as_of, 1)

    q = poll.poll_stream(_landed_stream(spark, sf), root, history, universe, _lexicon_scorer,
                         stream_ops.scratch_path(spark, "ckpt-poll"), available_now=True)
    q.awaitTermination()
    snap = snapshots.snapshot(spark, root)
    quoted = snapshots.read(spark, root, MARKET_QUOTES, snap).select("ticker", F.col("current_price").alias("quote"))
    stored = snapshots.read(spark, root, NEWS_STAGING, snap).groupBy("ticker").agg(F.count("*").alias("articles"))
    trades = snapshots.read(spark, root, TRADE_LEDGER, snap).select("ticker", "action", F.col("price").alias("trade_price"),
                                                                   X.py_round("rsi", 2).alias("rsi"))
    signals = snapshots.read(spark, root, poll.SIGNALS, snap).drop("rsi")
    return (signals.join(quoted, "ticker", "left").join(stored, "ticker", "left").join(trades, "ticker", "left")
            .select("ticker", "quote", F.coalesce("articles", F.lit(0)).cast("long").alias("articles"), "news_score", "news_alert",
                    F.col("news_count").cast("long").alias("news_count"), "sentiment_source", "avg_sentiment", "action", "trade_price", "rsi", "error"))


# ------------------------------------------------------------ landed feeds


def _feed_items(spark, sf):
    """Documents as feed items: a ticker per source, a fetch per 480 ids, primary feeds for English ones; some
    without link, address, title or publish time."""
    n = F.col("doc_id")
    at = F.timestamp_add("SECOND", n * 61, F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"))
    link = F.concat(F.lit("https://news.example/?a=1&id="), n.cast("string"))
    title = F.regexp_replace("text", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]", " ")
    return table(spark, sf, "documents").select(
        F.col("source").alias("ticker"), F.floor(n / 480).cast("long").alias("fetch"), (F.col("lang") == "en").alias("primary"), n, at.alias("at"),
        F.when(n % 13 == 0, F.lit("")).otherwise(F.concat(title, F.when(n % 3 == 0, F.lit(" - Reuters")).otherwise(F.lit("")))).alias("title"),
        F.when(n % 7 != 0, link).alias("link"))


def _land_primary(spark, items, path):
    epoch = X.epoch_seconds("at")
    item = F.struct("doc_id", "title", F.when(F.col("doc_id") % 5 != 0, F.col("link")).alias("link"), F.col("link").alias("url"),
                    F.when(F.col("doc_id") % 4 == 0, F.lit(0).cast("long")).otherwise(epoch).alias("providerPublishTime"),
                    F.when(F.col("doc_id") % 8 != 0, epoch).alias("publishedAt"))
    (items.groupBy("ticker", "fetch").agg(F.array_sort(F.collect_list(item)).alias("items"))
     .select("ticker", F.timestamp_seconds(F.lit(1704067200) + F.col("fetch") * 3600).alias("fetched_at"),
             F.transform("items", lambda i: i.dropFields("doc_id")).alias("items"))
     .write.json(path))


def _land_rss(spark, items, path):
    def tag(name, text):
        for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(plain), F.lit(escaped))
        return F.concat(F.lit(f"<{name}>"), text, F.lit(f"</{name}>"))

    # half of the dates are given in a zone two hours ahead
    ahead = F.regexp_replace(X.rss_format(F.timestamp_add("HOUR", F.lit(2), F.col("at"))), "GMT$", "+0200")
    date = F.when(F.col("doc_id") % 2 == 0, ahead).otherwise(X.rss_format("at"))
    item = F.concat(F.lit("<item>"), tag("title", F.col("title")), F.coalesce(tag("link", F.col("link")), F.lit("")),
                    F.when(F.col("doc_id") % 11 != 0, tag("pubDate", date)).otherwise(F.lit("")), F.lit("</item>"))
    built = X.rss_format(F.timestamp_add("HOUR", F.col("fetch"), F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")))
    (items.groupBy("ticker", "fetch").agg(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("xml")))).alias("items"))
     .select("ticker", "fetch", F.concat(F.lit("<rss><channel>"), tag("lastBuildDate", built), F.array_join(F.col("items.xml"), ""),
                                         F.lit("</channel></rss>")).alias("value"))
     .repartition("ticker", "fetch").write.partitionBy("ticker", "fetch").text(path))  # a file per fetch, as feeds come


@query
def landed_feeds(spark: SparkSession, sf: str) -> DataFrame:
    """Documents landed as JSON snapshots and RSS files, read back: each fetch's first 10
    articles, with the headline's digest."""
    items = _feed_items(spark, sf)
    json, rss = stream_ops.scratch_path(spark, "feed-json"), stream_ops.scratch_path(spark, "feed-rss")
    _land_primary(spark, items.filter("primary"), json)
    _land_rss(spark, items.filter("not primary"), rss)
    first = feeds.primary_articles(feeds.read_snapshots(spark, json))
    first = first.withColumn("fetched_at", stream_ops.wall_clock("fetched_at"))
    second = feeds.secondary_articles(feeds.read_feeds(spark, rss, n=feeds.FEED_LIMIT))
    return (first.select(*second.columns).unionByName(second)
            .select("ticker", "fetched_at", F.col("pos").cast("long").alias("pos"), F.md5("headline").alias("headline_md5"), "url",
                    "published_at", "source"))


@query
def landed_headlines(spark: SparkSession, sf: str) -> DataFrame:
    """Per ticker and fetch of the landed snapshots the number and the digest of its headlines, in feed order."""
    path = stream_ops.scratch_path(spark, "feed-json")
    _land_primary(spark, _feed_items(spark, sf).filter("primary"), path)
    h = feeds.batch_headlines(feeds.read_snapshots(spark, path))
    return h.select("ticker", stream_ops.wall_clock("fetched_at").alias("fetched_at"), F.size("headlines").cast("long").alias("n"),
                    F.md5(F.array_join(F.transform("headlines", F.md5), ",")).alias("headlines_md5"))


@query
def url_index_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """``url_dedup`` through the bucketed index of stored URLs."""
    d = table(spark, sf, "documents")
    incoming = d.select(F.md5("text").alias("url"), "doc_id", "source")
    root = stream_ops.scratch_path(spark, "url-index")
    url_index.add(d.filter(F.col("lang") == "de").select(F.md5("text").alias("url")), root, "url", 0)
    return keys.insert_ignore(incoming, url_index.stored_among(incoming, root, "url"), "url", ["doc_id"])
