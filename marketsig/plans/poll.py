"""R1 + P1-P4: a whole poll -- quotes, news, sentiment, signals, prompts, ledger -- as one batch.

A batch of landed rows of all kinds goes through the news plan, the assembly and the ledger, and
everything it produces is published as one commit: readers see the quotes, articles, signals and
trades of a poll together or not at all, and a replayed batch changes nothing.

Landed rows: ``kind`` (quote, news or reply), ``ticker``, ``at``, ``n`` (position, unique in a batch),
``payload`` (a quote's JSON or a reply), and of news ``headline``, ``url``, ``published_at``, ``source``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from marketsig.functions.scalar import time_literal
from marketsig.operators import indicators as ind
from marketsig.operators import keys, sentiment, snapshots, topk
from marketsig.operators.series import materialize
from marketsig.operators.validate import fill_defaults
from marketsig.plans import news as news_plan
from marketsig.plans import prompts as prompt_plan
from marketsig.plans import signals as sig
from marketsig.schemas import MARKET_QUOTES, NEWS_STAGING, SENTIMENT_SCORES, TRADE_LEDGER
from marketsig.sources.news import FEED_LIMIT, PRIMARY
from marketsig.streaming.monitor import monitor

LANDED = T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "ticker")]
                      + [T.StructField("at", T.TimestampType()), T.StructField("n", T.LongType())]
                      + [T.StructField(c, T.StringType()) for c in ("payload", "headline", "url")]
                      + [T.StructField("published_at", T.TimestampType()), T.StructField("source", T.StringType())])

SIGNALS, PROMPTS = "signals", "prompts"


def state(landed: DataFrame, stored: DataFrame, history: DataFrame, ledger: DataFrame, universe: DataFrame, as_of,
          score: Callable[[DataFrame], DataFrame], lookback_minutes: int = sentiment.LOOKBACK_MINUTES,
          recent_minutes: int = sentiment.RECENT_MINUTES) -> dict[str, DataFrame]:
    """Everything one poll writes, by table, from a batch and what is stored before it.

    ``stored`` are ``news_staging`` rows, ``ledger`` the trades so far, ``history`` (ticker, ts, n, price)
    the bars; ``score`` adds the E2 columns and ``sentiment_score`` to headlines."""
    of = lambda k: landed.filter(F.col("kind") == k)
    news = of("news")
    fetched, inserted = news_plan.ingest(
        news.filter(F.col("source") == PRIMARY), news.filter(F.coalesce("source", F.lit("")) != PRIMARY),
        stored.select("ticker", "source", "headline", "url", "published_at", "created_at", "sentiment_score"),
        lambda fresh: score(fresh.withColumnRenamed("at", "created_at")), "ticker", ("at", "n"))
    inserted = materialize(inserted)  # counted, stored and read by the signals
    articles = fill_defaults(inserted, NEWS_STAGING, as_of)
    columns = ["ticker", "created_at", "published_at", "sentiment_score"]
    alerts = news_plan.signals_from(stored.select(*columns).unionByName(articles.select(*columns)), fetched, as_of, universe,
                                    "ticker", lookback_minutes, recent_minutes)

    # the count path scores the newest headlines of tickers without recent news
    quiet = alerts.filter("articles_count = 0").select("ticker")
    heads = topk.top_k_per_key(news.filter(F.coalesce(F.length("headline"), F.lit(0)) > 0).join(quiet, "ticker", "left_semi"),
                               "ticker", [F.col("at").desc(), F.col("n").desc()], FEED_LIMIT)
    heads = score(heads.withColumnRenamed("at", "created_at"))
    counted = sentiment.count_path(heads, "ticker")

    quoted = of("quote").select("ticker", "at", "n", "payload")
    newest = sig.latest_quotes(quoted, "ticker", "at", "n")
    tech = sig.technical(history, "ticker", "ts", "price", "n")
    replies = ind.latest(of("reply").select("ticker", F.col("payload").alias("reply"), F.struct("at", "n").alias("_o")), "ticker", "_o")
    signals = materialize(sig.assemble(universe, newest, tech, alerts, counted, replies.drop("_o"), "ticker"))

    a = time_literal(as_of, "timestamp")
    market = fill_defaults(newest.withColumn("timestamp", F.col("at")), MARKET_QUOTES, as_of)
    scored = sentiment.sentiment_rows(heads, "ticker", "headline", a)
    return {
        "market_quotes": market, "news_staging": articles, "sentiment_scores": fill_defaults(scored, SENTIMENT_SCORES, as_of),
        SIGNALS: signals.withColumn("as_of", a),
        PROMPTS: prompt_plan.prompt_table(signals, prompt_plan.history_block(ledger)).withColumn("as_of", a),
        "trade_ledger": sig.ledger_rows(signals, a)}


SPECS = {s.name: s for s in (MARKET_QUOTES, NEWS_STAGING, SENTIMENT_SCORES, TRADE_LEDGER)}


def poll(landed: DataFrame, root: str, batch: tuple[str, int], history: Callable[[object], DataFrame], universe: DataFrame,
         score: Callable[[DataFrame], DataFrame], lookback_minutes: int = sentiment.LOOKBACK_MINUTES,
         recent_minutes: int = sentiment.RECENT_MINUTES) -> snapshots.Snapshot:
    """Run one batch against the tables under ``root`` and publish all it writes as one commit.

    ``batch`` is (stream, number).  The batch's newest ``at`` is its as-of time; an empty batch
    only marks its number.  ``history`` gives the bars for an as-of time."""
    spark = landed.sparkSession

    def change(base: snapshots.Snapshot) -> tuple[dict, dict]:
        as_of = landed.agg(F.max("at")).first()[0]
        if as_of is None:
            return {}, {}
        held = {name: snapshots.read(spark, root, spec, base) for name, spec in SPECS.items()}
        out = state(landed, held["news_staging"], history(as_of), held["trade_ledger"], universe, as_of, score,
                    lookback_minutes, recent_minutes)
        quotes = SPECS["market_quotes"]  # K2: a quote of a stored (ticker, timestamp) is ignored
        out["market_quotes"] = keys.insert_ignore(out["market_quotes"], held["market_quotes"], list(quotes.key), ["id"])
        return {name: [snapshots.stage(df, root, SPECS.get(name, name))] for name, df in out.items()}, {}

    return snapshots.transaction(spark, root, change, batch)


def poll_stream(stream: DataFrame, root: str, history: Callable[[object], DataFrame], universe: DataFrame,
                score: Callable[[DataFrame], DataFrame], checkpoint: str, name: str = "poll",
                lookback_minutes: int = sentiment.LOOKBACK_MINUTES, recent_minutes: int = sentiment.RECENT_MINUTES,
                available_now: bool = False) -> StreamingQuery:
    """``poll`` on every micro-batch of landed rows."""
    def run(batch: DataFrame, number: int) -> None:
        poll(materialize(batch), root, (name, number), history, universe, score, lookback_minutes, recent_minutes)
    return monitor(stream, run, checkpoint, available_now)
