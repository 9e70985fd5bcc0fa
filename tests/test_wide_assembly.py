"""The single-pass assembly against the frame-per-source assembly, its error branches and its plan;
date and quote parsers."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from marketsig.functions.scalar import rss_to_timestamp
from marketsig.operators import sentiment, topk, wide
from marketsig.plans import signals as sig
from marketsig.sources import bars, quotes
from tests.conftest import SF

AS_OF = dt.datetime(2024, 3, 1, 12)


def quote(c, **more):
    return json.dumps({"c": c, "d": 1.0, "dp": 2.0, "h": 3.0, "l": 4.0, "o": 5.0, "pc": 6.0, **more})


@pytest.fixture(scope="module")
def landed(spark):
    """(ticker, kind, ts, n, payload, price, score): tickers that reach every branch of the gate."""
    rows, n = [], 0

    def add(ticker, kind, minutes_ago, payload=None, price=None, score=None):
        nonlocal n
        n += 1
        rows.append((ticker, kind, AS_OF - dt.timedelta(minutes=minutes_ago), n, payload, price, score))

    for t in ("FULL", "NOQUOTE", "ZERO", "BROKEN", "COUNTED", "BARE"):
        for i in range(40):
            add(t, "bar", 60 * 24 * 29 - i * 600, price=100.0 + (i * 37) % 11 - i / 3)
        add(t, "bar", 60 * 24 * 200, price=1e6)  # older than the look-back
    for t in ("FULL", "NOHIST", "COUNTED", "BARE"):
        add(t, "quote", 90, quote(1.0))
        add(t, "quote", 5, quote(12.5, t="text", more={"a": [1]}))
    add("ZERO", "quote", 5, quote(0))
    add("BROKEN", "quote", 5, '{"c": 1.0}')
    add("NULLPRICE", "quote", 5, quote(None))
    add("NULLPRICE", "bar", 5, price=3.0)
    for t in ("FULL", "NOQUOTE", "NOHIST"):
        for i in range(25):
            add(t, "news", i * 5, score=((i * 61) % 200 - 100) / 100)
        add(t, "news", 1, score=None)
    for i in range(15):
        add("COUNTED", "news", 300 + i, score=0.5 if i % 3 else -0.9)
    return spark.createDataFrame(rows, "ticker string, kind string, ts timestamp_ntz, n long, payload string, price double, score double")


def apart(landed):
    """The same state from one frame per source and joins."""
    of = lambda k: landed.filter(F.col("kind") == k)
    universe = landed.select("ticker").distinct()
    hist = bars.lookback(of("bar"), "ts", AS_OF, 1)
    news = of("news").withColumnRenamed("ts", "created_at").withColumnRenamed("score", "sentiment_score")
    alerts = sentiment.weighted_scores(news, AS_OF, "ticker", universe=universe)
    # a headline without a score holds a place among the newest but no class
    heads = topk.top_k_per_key(news, "ticker", [F.col("created_at").desc(), F.col("n").desc()], 10).filter("sentiment_score is not null")
    counted = sentiment.count_path(heads.withColumn("sentiment", sentiment.sentiment_label("sentiment_score")), "ticker")
    return sig.assemble(universe, sig.latest_quotes(of("quote"), "ticker", "ts", "n"), sig.technical(hist, "ticker", "ts", "price", "n"),
                        alerts, counted)


def rows_of(df):
    return {r.ticker: tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()}


def test_wide_equals_apart_and_reaches_every_branch(spark, landed):
    w = wide.wide_state(landed, AS_OF, "ticker", "ts", "n", "price", "score", ["payload"], kind="kind")
    got = sig.assemble_wide(w)
    want = apart(landed)
    assert got.columns == want.columns and rows_of(got) == rows_of(want)
    r = {x.ticker: x for x in got.collect()}
    assert {t for t in r if r[t].error and r[t].error.startswith("Failed")} == {"NOQUOTE", "ZERO", "BROKEN"}
    assert {t for t in r if r[t].error == sig.NO_HISTORY} == {"NOHIST"}
    assert r["NOHIST"].current_price == 12.5 and r["NOHIST"].avg_sentiment is not None and r["NOHIST"].rsi is None and r["NOHIST"].decision is None
    assert r["NOQUOTE"].news_count > 0 and r["NOQUOTE"].avg_sentiment is None and r["NOQUOTE"].current_price is None
    assert r["FULL"].sentiment_source == "news_engine" and r["COUNTED"].sentiment_source == "headlines" and r["COUNTED"].total_headlines == 10
    assert (r["BARE"].avg_sentiment, r["BARE"].avg_score, r["BARE"].total_headlines) == ("neutral", 0.0, 0) and r["BARE"].decision == "HOLD"
    assert r["NULLPRICE"].error is None and r["NULLPRICE"].current_price is None and r["NULLPRICE"].rsi is None


def test_wide_on_an_empty_table(spark, landed):
    w = wide.wide_state(landed.limit(0), AS_OF, "ticker", "ts", "n", "price", "score", ["payload"], kind="kind")
    assert sig.assemble_wide(w).count() == 0


def test_assembly_scans_events_at_most_three_times(spark, monkeypatch):
    from marketsig.operators import series
    from marketsig.plans import catalog
    scans = []
    real, newest = series.materialize, catalog.newest

    monkeypatch.setattr(series, "materialize", lambda df: scans.append(1) or real(df))
    monkeypatch.setattr(catalog, "newest", lambda *a: scans.append(1) or newest(*a))
    df = catalog.signal_assembly(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    in_plan = sum("user_id" in line or "event_id" in line for line in plan.splitlines() if "Scan parquet" in line or "FileScan parquet" in line)
    assert len(scans) + in_plan <= 3 and in_plan == 1


def test_rfc822_dates(spark):
    cases = {"Mon, 01 Jan 2024 00:00:07 GMT": "2024-01-01 00:00:07", "Mon, 1 Jan 2024 00:00:07 +0200": "2023-12-31 22:00:07",
             "1 Jan 2024 9:05 -0330": "2024-01-01 12:35:00", "Tue, 02 Jan 24 23:30:00 EST": "2024-01-03 04:30:00",
             "wed,03 JAN 2024 01:02:03 z": "2024-01-03 01:02:03", "04 January 2024 01:02:03": "2024-01-04 01:02:03",
             "01 Jan 99 00:00:00 UT": "1999-01-01 00:00:00", "Mon, 32 Jan 2024 00:00:00 GMT": None, "01 Foo 2024 00:00:00 GMT": None,
             "01 Jan 2024 00:00:00 XYZ": None, "": None, "yesterday": None, None: None}
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").select("i", rss_to_timestamp("c").cast("string").alias("t"))
    assert [r.t for r in df.orderBy("i").collect()] == list(cases.values())


def test_quotes_with_extra_fields(spark):
    rows = [quote(1.5), quote(1.5, note="x", deep={"a": 1}, flag=True, none=None), quote(0), quote(None), '{"c": 1}', "[1]", "", None, quote("7.25")]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, payload string")
    assert {r.i: r.current_price for r in quotes.decode(df).collect()} == {0: 1.5, 1: 1.5, 3: None, 8: 7.25}
