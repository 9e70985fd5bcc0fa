"""Operators on empty inputs return empty (or default) results, never fail."""

import datetime as dt

from pyspark.sql import functions as F

from marketsig.operators import indicators as ind
from marketsig.operators import keys, sentiment, topk
from marketsig.plans import news as news_plan

T0 = dt.datetime(2026, 1, 27, 12, 0)
SERIES = "ticker string, ts timestamp_ntz, seq long, close double"


def test_empty_series(spark):
    df = spark.createDataFrame([], SERIES)
    assert ind.latest_indicators(df, "ticker", "ts", "close", "seq").count() == 0
    d = ind.with_position(df, "ticker", "ts", "seq")
    assert ind.rsi(ind.macd(d, "ticker", "close"), "ticker", "close").count() == 0
    assert topk.history_before(df, "ticker", "ts", "seq", 5, ["close"]).count() == 0


def test_empty_news(spark):
    cols = "ticker string, url string, headline string, created_at timestamp_ntz, published_at timestamp_ntz, pos int"
    empty = spark.createDataFrame([], cols)
    existing = spark.createDataFrame([], "ticker string, url string, headline string, created_at timestamp_ntz, "
                                         "published_at timestamp_ntz, sentiment_score double")
    universe = spark.createDataFrame([("AAPL",)], "ticker string")
    sig, new = news_plan.news_signals(empty, empty, existing, lambda d: d.withColumn("sentiment_score", F.lit(0.5)),
                                      T0, universe)
    r = sig.collect()
    assert len(r) == 1 and r[0].articles_count == 0 and r[0].score == 0.0 and r[0].direction == "neutral"
    assert new.count() == 0
    assert keys.insert_ignore(empty, None, "url", ["pos"]).count() == 0


def test_empty_universe_and_scores(spark):
    news = spark.createDataFrame([], "ticker string, created_at timestamp_ntz, sentiment_score double")
    assert sentiment.weighted_scores(news, T0).count() == 0
    heads = spark.createDataFrame([], "ticker string, sentiment string")
    universe = spark.createDataFrame([("X",)], "ticker string")
    r = sentiment.count_path(heads, "ticker", universe=universe).first()
    assert r.total_headlines == 0 and r.avg_sentiment == "neutral"
