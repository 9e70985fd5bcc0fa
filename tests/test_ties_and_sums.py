"""Ties of any sign or none, ids of any size, scores next to the alert threshold."""

import datetime as dt

from pyspark.sql import functions as F

from marketsig.operators import sentiment
from marketsig.sources import bars

T0 = dt.datetime(2024, 1, 2, 10)


def test_bars_with_signed_and_null_ties(spark):
    us = dt.timedelta(microseconds=1)
    big = (1 << 63) - 1
    rows = [("a", T0, big, 1.0), ("a", T0 + us, -big - 1, 2.0), ("b", T0, -5, 3.0), ("b", T0, 4, 4.0), ("c", T0, None, 5.0), ("c", T0, -big - 1, 6.0),
            ("d", T0, None, 7.0)]
    d = spark.createDataFrame(rows, "k string, ts timestamp_ntz, tie long, p double")
    got = {r.k: (r.open, r.close) for r in bars.daily_bars(d, "k", "ts", "p", "tie").collect()}
    assert got == {"a": (1.0, 2.0), "b": (3.0, 4.0), "c": (5.0, 6.0), "d": (7.0, 7.0)}


def test_recent_news_orders_large_ids(spark):
    ids = [5, 10**18, 3 * 10**18, 9 * 10**18, -7, 10**16]
    rows = [("T", T0, None, i, 0.1) for i in ids] + [("T", T0, T0 - dt.timedelta(minutes=m), 100 + m, 0.1) for m in (3, 1, 2)]
    d = spark.createDataFrame(rows, "ticker string, created_at timestamp_ntz, published_at timestamp_ntz, id long, sentiment_score double")
    got = [r.id for r in sentiment.recent_news(d, T0, tie="id").orderBy("rank").collect()]
    assert got == sorted(ids) + [101, 102, 103]


def test_alert_on_the_unrounded_score(spark):
    under = 0.7 - 1e-12
    rows = [("u", T0, under), ("u", T0, under), ("e", T0, 0.7), ("o", T0, -0.7 - 1e-12)]
    d = spark.createDataFrame(rows, "ticker string, created_at timestamp_ntz, sentiment_score double")
    got = {r.ticker: (r.alert, r.score) for r in sentiment.weighted_scores(d, T0).collect()}
    assert got == {"u": (False, 0.7), "e": (True, 0.7), "o": (True, -0.7)}
