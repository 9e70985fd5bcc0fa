import datetime as dt
import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketsig.operators import indicators as ind
from marketsig.operators import sentiment
from marketsig.session import scratch_path
from marketsig.sources import news
from marketsig.streaming import monitor as M

SF = "/root/testdata/sf0.01"


def _event_scores(df):
    return df.select(F.col("event_type").alias("ticker"), "ts",
                     (((F.col("event_id") * 37) % 201 - 100) / F.lit(100.0)).alias("sentiment_score"))


def test_stream_equals_batch_on_closed_windows(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    s = M.event_time(_event_scores(s), "ts")
    streamed = M.run_to_table(M.sliding_scores(s, "ticker", "event_time", "sentiment_score"), spark, "t-stream")
    # Batch: the weighted score of one window = A6 with as_of = window end
    # (window end is exclusive, so rows at exactly the end are excluded).
    b = M.event_time(_event_scores(spark.read.parquet(f"{SF}/events.parquet")), "ts")
    w = streamed.select("ticker", "window", "raw_score").orderBy("window.start").limit(40).collect()
    for r in w:
        rows = b.filter((F.col("ticker") == r.ticker) & (F.col("event_time") >= r.window.start)
                        & (F.col("event_time") < r.window.end))
        got = sentiment.weighted_scores(rows, F.lit(r.window.end), "ticker", "event_time").first()
        assert abs(got.raw_score - r.raw_score) < 1e-12


def test_model_scorer_udf(spark):
    def make():
        def score(texts):
            return [[0.1, 0.2, 0.7] if "good" in t else [0.6, 0.3, 0.1] for t in texts]
        return score
    df = spark.createDataFrame([(1, "good news"), (2, "bad news"), (3, None)], "id int, text string")
    out = {r.id: r for r in sentiment.score_text(df, "text", make, batch_size=2).collect()}
    assert out[1].sentiment == "positive" and abs(out[1].score - 0.6) < 1e-12
    assert out[2].sentiment == "negative" and abs(out[3].score + 0.5) < 1e-12


def test_monitor_runs_batches(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    out = scratch_path(spark, "t-monitor")
    q = M.monitor(s.select("event_type", "value"), M.batch_writer(out), scratch_path(spark, "t-monitor-ck"),
                  available_now=True)
    q.awaitTermination()
    assert spark.read.parquet(out).count() == 10000


def test_rss_reader(spark, tmp_path):
    xml = """<rss><channel>
<item><title>&lt;b&gt;Apple&lt;/b&gt; soars - Reuters</title><link>https://x/1</link><pubDate>Mon, 01 Jan 2024 00:00:07 GMT</pubDate></item>
<item><title>Fed holds</title><link>https://x/2</link><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate></item>
</channel></rss>"""
    p = tmp_path / "feed.xml"
    p.write_text(xml)
    items = news.read_rss(spark, str(p)).withColumn("ticker", F.lit("AAPL")).withColumn("pos", F.lit(0))
    got = sorted((r.headline, r.url, r.published_at) for r in news.secondary_articles(items).collect())
    assert got[0] == ("Apple soars", "https://x/1", dt.datetime(2024, 1, 1, 0, 0, 7))


def test_hot_key_chunks_match_single_window(spark):
    """One series holding every row, cut into many chunks, gives the same
    delta / rolling mean / RSI / MACD as one window over the whole series."""
    ev = spark.read.parquet(f"{SF}/events.parquet").withColumn("k", F.lit("HOT"))
    d = ind.with_position(ev, "k", "ts", "event_id")
    small = ind.rsi(ind.rolling_mean(d, "k", "value", 14, "m14", chunk_rows=97), "k", "value", chunk_rows=113)
    small = ind.macd(small, "k", "value", chunk_rows=71)
    w = Window.partitionBy("k").orderBy("ts", "event_id")
    ref = (ev.withColumn("rn", F.row_number().over(w))
           .withColumn("m14_ref", F.when(F.col("rn") >= 14, F.avg("value").over(w.rowsBetween(-13, 0)))))
    j = small.join(ref.select("event_id", "rn", "m14_ref"), "event_id")
    assert j.filter(F.col("_pos") != F.col("rn") - 1).count() == 0
    assert j.filter(F.abs(F.coalesce(F.col("m14") - F.col("m14_ref"), F.lit(0.0))) > 1e-9).count() == 0
    full = ind.macd(d, "k", "value").select("event_id", F.col("signal").alias("s_full"))
    assert small.join(full, "event_id").filter(F.abs(F.col("signal") - F.col("s_full")) > 1e-9).count() == 0
    assert small.filter((F.col("rsi") < 0) | (F.col("rsi") > 100)).count() == 0


def test_watermark_dedup(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    s = (spark.readStream.schema(docs.schema).option("pathGlobFilter", "documents.parquet").parquet(SF)
         .select(F.md5("text").alias("url"), "doc_id")
         .withColumn("event_time", F.timestamp_seconds(F.lit(1_700_000_000))))
    out = M.run_to_table(M.dedup_within_watermark(s, "url", "event_time"), spark, "t-wm-dedup")
    assert out.count() == docs.select(F.md5("text")).distinct().count()


def test_news_monitor_two_batches(spark, tmp_path):
    from pyspark.sql import types as T
    land = tmp_path / "landed"
    land.mkdir()
    base = dt.datetime(2026, 1, 27, 12, 0)
    schema = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("url", T.StringType()),
                           T.StructField("headline", T.StringType()),
                           T.StructField("created_at", T.TimestampNTZType()),
                           T.StructField("published_at", T.TimestampNTZType()),
                           T.StructField("pos", T.IntegerType()), T.StructField("source", T.StringType())])
    b1 = [("AAPL", "u1", "good", base, None, 0, "yfinance"), ("MSFT", "u2", "bad", base, None, 0, "yfinance")]
    b2 = [("MSFT", "u1", "good again", base + dt.timedelta(minutes=5), None, 0, "yfinance"),
          ("AAPL", "u3", "good", base + dt.timedelta(minutes=10), None, 0, "google_news")]
    for i, rows in enumerate([b1, b2]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(land / f"b{i}"))
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(str(land)))
    stored_schema = T.StructType([f for f in schema.fields if f.name not in ("pos", "source")]
                                 + [T.StructField("sentiment_score", T.DoubleType()),
                                    T.StructField("batch_id", T.LongType())])
    universe = spark.createDataFrame([("AAPL",), ("MSFT",), ("TSLA",)], "ticker string")
    score = lambda df: df.withColumn("sentiment_score",
                                     F.when(F.col("headline").startswith("good"), 0.9).otherwise(-0.9))
    table, sig = str(tmp_path / "news"), str(tmp_path / "signals")
    q = M.news_monitor(stream, table, sig, score, universe, str(tmp_path / "ck"), stored_schema,
                       available_now=True)
    q.awaitTermination()
    stored = spark.read.parquet(table)
    assert sorted(r.url for r in stored.collect()) == ["u1", "u2", "u3"]       # u1 kept once (M14)
    assert stored.filter("url = 'u1'").first().ticker == "AAPL"
    s = {(r.batch_id, r.ticker): r for r in spark.read.parquet(sig).collect()}
    assert s[(0, "AAPL")].articles_count == 1 and s[(0, "AAPL")].alert
    assert s[(0, "TSLA")].articles_count == 0
    assert s[(1, "AAPL")].articles_count == 2       # stored u1 + new u3 (secondary used: no primary)
    assert s[(1, "MSFT")].articles_count == 1       # its stored u2; its u1 copy was not inserted


def test_adaptive_blocks_split_hot_buckets(spark):
    """A tiny row limit makes every day and hour 'hot', so rows are ranked in
    minute blocks; positions must equal one window over the series."""
    from marketsig.operators.series import index_series_adaptive
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    hot = ev.withColumn("k", F.when(F.col("user_id") % 3 == 0, F.lit("HOT")).otherwise(F.col("event_type")))
    order = [F.col("ts"), F.col("event_id")]
    got = index_series_adaptive(hot, "k", "ts", order, max_block_rows=3, size_col="n")
    w = Window.partitionBy("k").orderBy("ts", "event_id")
    ref = hot.withColumn("rn", F.row_number().over(w) - 1).withColumn("cnt", F.count(F.lit(1)).over(Window.partitionBy("k")))
    j = got.join(ref.select("event_id", "rn", "cnt"), "event_id")
    assert j.count() == ev.count()
    assert j.filter((F.col("_pos") != F.col("rn")) | (F.col("n") != F.col("cnt"))).count() == 0


def test_stream_bars_equal_batch_bars_for_closed_days(spark):
    from marketsig.sources import bars
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    s = M.event_time(s, "ts")
    out = M.run_to_table(M.daily_bars_stream(s, "event_type", "event_time", "value", "event_id"), spark, "t-bars")
    streamed = out.select("event_type", M.wall_clock(F.col("day.start")).cast("date").alias("date"),
                          "open", "high", "low", "close", "volume")
    batch = bars.daily_bars(spark.read.parquet(f"{SF}/events.parquet"), "event_type", "ts", "value", "event_id")
    rows = lambda df: sorted(map(tuple, df.collect()))
    n = streamed.count()
    assert n > 0 and n < batch.count()                      # the last day is still open
    assert rows(streamed) == rows(batch.join(streamed.select("event_type", "date"), ["event_type", "date"])
                                  .select("event_type", "date", "open", "high", "low", "close", "volume"))


def test_rss_stream(spark, tmp_path):
    d = tmp_path / "rss"
    d.mkdir()
    (d / "a.xml").write_text("<rss><channel><item><title>A - Reuters</title><link>https://x/1</link>"
                             "<pubDate>Mon, 01 Jan 2024 00:00:07 GMT</pubDate></item></channel></rss>")
    s = news.read_rss(spark, str(d), stream=True).withColumn("ticker", F.lit("T")).withColumn("pos", F.lit(0))
    out = M.run_to_table(news.secondary_articles(s), spark, "t-rss-stream")
    r = out.first()
    assert (r.headline, r.url, r.published_at) == ("A", "https://x/1", dt.datetime(2024, 1, 1, 0, 0, 7))


def test_exact_state_dedup(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    s = (spark.readStream.schema(docs.schema).option("pathGlobFilter", "documents.parquet").parquet(SF)
         .select(F.md5("text").alias("url"), "doc_id"))
    out = M.run_to_table(M.dedup_exact_state(s, "url"), spark, "t-state-dedup")
    assert out.count() == out.select("url").distinct().count() == docs.select(F.md5("text")).distinct().count()


def test_model_scorer_class_order(spark):
    def make():
        return lambda texts: [[0.7, 0.2, 0.1] for _ in texts]       # positive, negative, neutral
    df = spark.createDataFrame([(1, "x")], "id int, text string")
    r = sentiment.score_text(df, "text", make, class_order=("positive", "negative", "neutral")).first()
    assert r.sentiment == "positive" and abs(r.p_positive - 0.7) < 1e-12 and abs(r.score - 0.5) < 1e-12


def test_adaptive_blocks_split_identical_timestamps(spark):
    """A third of the rows share one timestamp: only the tie levels can split
    them; positions must still equal one window over the series."""
    from marketsig.operators.series import index_series_adaptive
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    hot = ev.withColumn("k", F.when(F.col("user_id") % 3 == 0, F.lit("HOT")).otherwise(F.col("event_type")))
    hot = hot.withColumn("ts", F.when(F.col("k") == "HOT", F.expr("TIMESTAMP_NTZ'2024-01-15 00:00:00'"))
                         .otherwise(F.col("ts")))
    got = index_series_adaptive(hot, "k", "ts", [F.col("ts"), F.col("event_id")], max_block_rows=7,
                                size_col="n", tie="event_id")
    w = Window.partitionBy("k").orderBy("ts", "event_id")
    ref = hot.withColumn("rn", F.row_number().over(w) - 1)
    j = got.join(ref.select("event_id", "rn"), "event_id")
    assert j.count() == ev.count() and j.filter(F.col("_pos") != F.col("rn")).count() == 0
