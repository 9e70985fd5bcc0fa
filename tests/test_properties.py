"""SURVEY section 5 properties on the landed test tables."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from marketsig.operators import keys, sentiment

SF = "/root/testdata/sf0.01"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_ratios_sum_to_one(spark):
    ns = E.queries()["net_sentiment"](spark, SF).filter("total_headlines > 0")
    bad = ns.filter(F.abs(F.col("positive_ratio") + F.col("negative_ratio") + F.col("neutral_ratio") - 1) > 1e-12)
    assert ns.count() > 0 and bad.count() == 0


def test_weighted_score_bounded(spark):
    ws = E.queries()["weighted_score"](spark, SF)
    assert ws.filter(F.abs("raw_score") > 1).count() == 0
    st = E.queries()["stream_weighted"](spark, SF)
    assert st.filter(F.abs("raw_score") > 1).count() == 0


def test_insert_ignore_idempotent(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select(F.md5("text").alias("url"), "doc_id", "source")
    once = keys.insert_ignore(d, None, "url", ["doc_id"])
    twice = keys.insert_ignore(once.unionByName(d), None, "url", ["doc_id"])
    assert _rows(once) == _rows(twice)
    assert keys.insert_ignore(d, once.select("url"), "url", ["doc_id"]).count() == 0


def test_repartition_invariance(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    news = ev.select(F.col("event_type").alias("ticker"), F.col("ts").alias("created_at"),
                     (((F.col("event_id") * 37) % 201 - 100) / F.lit(100.0)).alias("sentiment_score"))
    as_of = ev.agg(F.max("ts")).first()[0]
    a = sentiment.weighted_scores(news, as_of, lookback_minutes=4320, recent_minutes=720)
    b = sentiment.weighted_scores(news.repartition(13, "created_at"), as_of, lookback_minutes=4320,
                                  recent_minutes=720)
    ra = {r.ticker: (r.articles_count, round(r.raw_score, 12)) for r in a.collect()}
    rb = {r.ticker: (r.articles_count, round(r.raw_score, 12)) for r in b.collect()}
    assert ra == rb
    from marketsig.operators import indicators as ind
    x = ind.latest_indicators(ev, "user_id", "ts", "value", "event_id")
    y = ind.latest_indicators(ev.repartition(7), "user_id", "ts", "value", "event_id")
    j = x.alias("a").join(y.alias("b"), "user_id").filter(F.abs(F.col("a.macd") - F.col("b.macd")) > 1e-9)
    assert j.count() == 0
