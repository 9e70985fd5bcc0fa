"""Per-ticker signal assembly for any as-of time, all tickers in
one plan (J1 joins, J2 sentiment source choice, F7 error gate), and the
ledger row built from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketsig.functions.text import decision_or_default
from marketsig.operators import indicators as ind
from marketsig.operators import sentiment
from marketsig.operators.validate import surrogate_id
from marketsig.schemas import TRADE_LEDGER
from marketsig.sources import quotes as Q

# The error texts of the ingestion and technical stages.
NO_QUOTE = "Failed to fetch market data for "
NO_HISTORY = "No price history available for technical analysis"

SENTIMENT_COLS = ["avg_sentiment", "avg_score", "positive_ratio", "negative_ratio", "neutral_ratio",
                  "total_headlines", "sentiment_source"]
MARKET_COLS = list(Q.PAYLOAD_FIELDS.values())


def latest_quotes(landed: DataFrame, key: str, ts: str, tie: str | None = None,
                  payload: str = "payload") -> DataFrame:
    """The quote each ticker's fetch returns now: its newest landed payload
    (ties broken by ``tie``), decoded; a zero price means no quote (the
    ticker is absent)."""
    order = [ts] + ([tie] if tie else [])
    last = ind.latest(landed.select(key, *order, payload)
                      .withColumn("_o", F.struct(*[F.col(c) for c in order])), key, "_o")
    return Q.decode(last.drop("_o"), payload)


def technical(history: DataFrame, key: str, ts: str, price: str, tie: str | None = None,
              block_unit: str | None = None) -> DataFrame:
    """W8 + W7 + E4: each ticker's indicators at its newest bar (closed-form
    aggregate, see ``indicators.latest_indicators``)."""
    last = ind.latest_indicators(history, key, ts, price, tie, block_unit=block_unit)
    return ind.interpret(last.select(key, "rsi", "macd", "signal", "histogram"))


def choose_sentiment(alerts: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    """The weighted path when the news plan found articles, else the count
    path; a ticker in neither has the neutral default (no headlines, all zero)."""
    w = sentiment.from_alert(alerts).select(
        key, "articles_count", *[F.col(c).alias(f"w_{c}") for c in SENTIMENT_COLS[:-1]])
    c = counted.select(key, *[F.col(x).alias(f"c_{x}") for x in SENTIMENT_COLS[:-1]])
    use_w = F.coalesce(F.col("articles_count"), F.lit(0)) > 0
    j = w.join(c, key, "full_outer")
    return j.select(key, *[_or_neutral(F.when(use_w, F.col(f"w_{x}")).otherwise(F.col(f"c_{x}")), x) for x in SENTIMENT_COLS[:-1]],
                    F.when(use_w, F.lit("news_engine")).otherwise(F.lit("headlines")).alias("sentiment_source"))


def _or_neutral(value, name: str):
    default = {"avg_sentiment": F.lit("neutral"), "total_headlines": F.lit(0).cast("long"), "sentiment_source": F.lit("headlines")}
    return F.coalesce(value, default.get(name, F.lit(0.0))).alias(name)


def assemble(universe: DataFrame, quotes: DataFrame, tech: DataFrame, alerts: DataFrame,
             counted: DataFrame, replies: DataFrame | None = None, key: str = "ticker") -> DataFrame:
    """J1 + F7: one row per ticker of the universe, from a frame per source (see ``gate``).

    ``replies`` (key, reply) gives the decision; a ticker without a reply gets the failed-call default.
    """
    u = universe.select(key)
    mkt = quotes.select(key, F.lit(True).alias("_has_quote"), *MARKET_COLS)
    te = tech.withColumn("_has_hist", F.lit(True))
    news = alerts.select(key, F.col("score").alias("news_score"), F.col("alert").alias("news_alert"),
                         F.col("articles_count").alias("news_count"),
                         F.col("direction").alias("news_direction"))
    sent = choose_sentiment(alerts, counted, key)
    j = u.join(news, key, "left").join(mkt, key, "left").join(te, key, "left").join(sent, key, "left")
    j = j.withColumns({c: _or_neutral(F.col(c), c) for c in SENTIMENT_COLS})
    return gate(_with_replies(j, replies, key), key)


def assemble_wide(wide: DataFrame, replies: DataFrame | None = None, key: str = "ticker",
                  payload: str = "payload") -> DataFrame:
    """J1 + J2 + F7 from ``wide.wide_state`` rows whose ``payload`` is the newest quote's: no joins but the replies'."""
    s = sentiment.from_alert(wide).select(
        key, payload, "has_quote", "bars", "rsi", "macd", "signal", "histogram",
        *[F.col(c).alias(f"c_{c}") for c in ("positive_count", "negative_count", "neutral_count")],
        F.col("score").alias("news_score"), F.col("alert").alias("news_alert"), F.col("articles_count").alias("news_count"),
        F.col("direction").alias("news_direction"), *[F.col(c).alias(f"w_{c}") for c in SENTIMENT_COLS[:-1]])
    total = F.col("c_positive_count") + F.col("c_negative_count") + F.col("c_neutral_count")
    counted = sentiment.count_columns(s.withColumns(
        {**{c: F.col(f"c_{c}") for c in ("positive_count", "negative_count", "neutral_count")}, "total_headlines": total}))
    use_w = F.col("news_count") > 0
    j = counted.withColumns({c: F.when(use_w, F.col(f"w_{c}")).otherwise(F.col(c)) for c in SENTIMENT_COLS[:-1]})
    j = j.withColumn("sentiment_source", F.when(use_w, F.lit("news_engine")).otherwise(F.lit("headlines")))
    j = j.withColumn("_quote", F.when(F.col("has_quote"), Q.quote_struct(payload)))
    j = j.withColumns({"_has_quote": F.when(F.col("_quote").isNotNull(), True), "_has_hist": F.when(F.col("bars") > 0, True),
                       **{c: F.col(f"_quote.{c}") for c in MARKET_COLS}})
    return gate(_with_replies(ind.interpret(j), replies, key), key)


def _with_replies(j: DataFrame, replies: DataFrame | None, key: str) -> DataFrame:
    if replies is None:
        return j.withColumn("reply", F.lit(None).cast("string"))
    return j.join(replies.select(key, "reply"), key, "left")


def gate(j: DataFrame, key: str = "ticker") -> DataFrame:
    """``error`` is the first failing stage (no quote, then no price history).

    News runs first and its failures are not errors, so it is always kept; without a quote neither
    market nor sentiment nor anything later exists, without a history market and sentiment do."""
    error = F.coalesce(F.when(F.col("_has_quote").isNull(), F.concat(F.lit(NO_QUOTE), F.col(key))),
                       F.when(F.col("_has_hist").isNull(), F.lit(NO_HISTORY)))
    j = j.withColumn("error", error)
    quoted, ok = F.col("_has_quote").isNotNull(), F.col("error").isNull()
    j = j.withColumn("_d", F.when(ok, decision_or_default("reply", F.lit("no reply from the decision model"))))
    technical_cols = ["rsi", "macd", "signal", "histogram", "rsi_zone", "macd_trend", "momentum", "outlook"]
    return j.select(key, "news_score", "news_alert", "news_count", "news_direction", *MARKET_COLS,
                    *[F.when(quoted, F.col(c)).alias(c) for c in SENTIMENT_COLS],
                    *[F.when(ok, F.col(c)).alias(c) for c in technical_cols],
                    *[F.col(f"_d.{c}").alias(c) for c in ("decision", "confidence", "reasoning", "thinking_process", "approved")],
                    "error")


def ledger_rows(signals: DataFrame, as_of, key: str = "ticker") -> DataFrame:
    """Trade-ledger rows of the tickers without an error (quantity 0),
    id from (ticker, as-of) so a rerun produces the same ids."""
    from marketsig.functions.scalar import time_literal
    a = time_literal(as_of, "timestamp_ntz")
    ok = signals.filter(F.col("error").isNull())
    return ok.select(
        surrogate_id(F.col(key), a).alias("id"), F.col(key).alias("ticker"), F.col("decision").alias("action"),
        F.col("current_price").alias("price"), F.lit(0).alias("quantity"), "reasoning",
        F.col("avg_score").alias("sentiment_avg"), "rsi", "macd", "approved",
        F.col("thinking_process").alias("portfolio_manager_reasoning"),
        a.cast(TRADE_LEDGER.schema["timestamp"].dataType).alias("timestamp"))


def as_state(signals: DataFrame, as_of, key: str = "ticker") -> DataFrame:
    """The per-ticker state record: one row per
    ticker and as-of time with ``market``, ``news_alert``, ``sentiment``,
    ``technical`` and ``decision`` structs and the ``error`` text."""
    from marketsig.functions.scalar import time_literal
    c = F.col
    return signals.select(
        c(key).alias("ticker"), time_literal(as_of, "timestamp_ntz").alias("as_of"),
        F.struct(*[c(x) for x in ("current_price", "change", "percent_change", "high", "low", "open",
                                  "previous_close")]).alias("market"),
        F.struct(c("news_score").alias("score"), c("news_alert").alias("alert"),
                 c("news_count").alias("articles_count"), c("news_direction").alias("direction")).alias("news_alert"),
        F.struct(*[c(x) for x in ("avg_sentiment", "avg_score", "positive_ratio", "negative_ratio", "neutral_ratio",
                                  "total_headlines")], c("sentiment_source").alias("source")).alias("sentiment"),
        F.struct(*[c(x) for x in ("rsi", "macd", "signal", "histogram")],
                 F.concat_ws("; ", c("rsi_zone"), c("macd_trend"), c("momentum"), c("outlook")).alias("analysis"))
        .alias("technical"),
        F.struct(*[c(x) for x in ("decision", "confidence", "reasoning", "thinking_process", "approved")])
        .alias("decision"),
        c("error"))
