"""News sources (S3-S6): landed feed snapshots -> article rows.

A landed snapshot is one row per (ticker, fetch) holding the feed's items as
an array in feed order, so "the first 10 items" is a position filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketsig.functions.scalar import EPOCH, falsy_coalesce, from_epoch, rss_to_timestamp
from marketsig.functions.text import clean_headline

# Items taken per feed and the source labels.
FEED_LIMIT = 10
PRIMARY = "yfinance"
SECONDARY = "google_news"

PRIMARY_ITEM = T.StructType([T.StructField("title", T.StringType()),
                             T.StructField("link", T.StringType()),
                             T.StructField("url", T.StringType()),
                             T.StructField("providerPublishTime", T.LongType()),
                             T.StructField("publishedAt", T.LongType())])
PRIMARY_SNAPSHOT = T.StructType([T.StructField("ticker", T.StringType()),
                                 T.StructField("fetched_at", T.TimestampType()),
                                 T.StructField("items", T.ArrayType(PRIMARY_ITEM))])
RSS_ITEM = T.StructType([T.StructField("ticker", T.StringType()),
                         T.StructField("title", T.StringType()),
                         T.StructField("link", T.StringType()),
                         T.StructField("pubDate", T.StringType())])
RSS_CHANNEL = T.StructType([T.StructField("lastBuildDate", T.StringType()),
                            T.StructField("item", T.ArrayType(T.StructType(RSS_ITEM.fields[1:]))),
                            T.StructField("ticker", T.StringType())])


def _first_n(df: DataFrame, n: int) -> DataFrame:
    from marketsig.operators.topk import first_n_items
    return first_n_items(df, "items", n)


def primary_articles(snapshots: DataFrame, n: int = FEED_LIMIT) -> DataFrame:
    """S3: first ``n`` items, cleaned; publish time from the first non-zero of
    two epoch fields; URL from the first non-empty of link/url; rows without a
    headline or URL are dropped *after* the limit."""
    d = _first_n(snapshots, n)
    return (d.select(
        *[c for c in d.columns if c not in ("pos", "item")], "pos",
        clean_headline(F.coalesce(F.col("item.title"), F.lit(""))).alias("headline"),
        falsy_coalesce("item.link", F.coalesce(F.col("item.url"), F.lit("")), empty="").alias("url"),
        from_epoch(F.nullif(falsy_coalesce("item.providerPublishTime", "item.publishedAt"), F.lit(0)))
        .alias("published_at"),
        F.lit(PRIMARY).alias("source"))
        .filter((F.col("headline") != "") & (F.col("url") != "")))


def secondary_articles(items: DataFrame, n: int = FEED_LIMIT, order: str = "pos") -> DataFrame:
    """RSS items (one row each, with a feed position), first ``n`` per
    ticker and fetch; empty headlines are kept, only an empty URL drops a row
    later (in the news plan)."""
    d = items.filter(F.col(order) < n)
    return d.select(
        *[c for c in d.columns if c not in ("title", "link", "pubDate")],
        clean_headline(F.coalesce(F.col("title"), F.lit(""))).alias("headline"),
        F.coalesce(F.col("link"), F.lit("")).alias("url"),
        rss_to_timestamp("pubDate").alias("published_at"),
        F.lit(SECONDARY).alias("source"))


def read_snapshots(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Landed primary-feed snapshots: JSON lines of ``{ticker, fetched_at,
    items: [...]}`` in feed order, read with the fixed schema."""
    r = spark.readStream if stream else spark.read
    return r.schema(PRIMARY_SNAPSHOT).json(path)


def read_rss(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """RSS XML files -> one row per ``<item>`` (Spark's built-in XML reader),
    as a batch or, with ``stream=True``, as a file stream."""
    r = spark.readStream if stream else spark.read
    return (r.format("xml").option("rowTag", "item")
            .schema(T.StructType([f for f in RSS_ITEM.fields if f.name != "ticker"])).load(path))


def read_feeds(spark: SparkSession, path: str, stream: bool = False, n: int | None = None) -> DataFrame:
    """Landed RSS files -> (ticker, fetched_at, pos, title, link, pubDate), one row per item.

    The ticker is the ``ticker=...`` folder of the file or else the file's name up to its first dot;
    ``fetched_at`` (UTC wall clock) is the channel's ``lastBuildDate``, or the time the file was landed
    where that is missing or unreadable.  ``pos`` counts the items of a channel from 0 in feed order;
    ``n`` keeps the first so many.  A channel without items gives no rows.
    """
    r = spark.readStream if stream else spark.read
    raw = r.format("xml").option("rowTag", "channel").schema(RSS_CHANNEL).load(path)
    landed = F.timestamp_add("MICROSECOND", F.unix_micros(F.col("_metadata.file_modification_time")), F.expr(EPOCH))
    items = F.col("item") if n is None else F.slice("item", 1, n)
    return (raw.select(F.coalesce("ticker", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1)).alias("ticker"),
                       F.coalesce(rss_to_timestamp("lastBuildDate"), landed).alias("fetched_at"), F.posexplode(items).alias("pos", "_item"))
            .select("ticker", "fetched_at", "pos", "_item.title", "_item.link", "_item.pubDate"))


def headlines(snapshots: DataFrame, n: int = FEED_LIMIT) -> DataFrame:
    """The first ``n`` titles of each snapshot that are non-empty."""
    d = _first_n(snapshots, n)
    return (d.select(*[c for c in d.columns if c not in ("item",)], F.col("item.title").alias("title"))
            .drop("item").filter(F.coalesce(F.length("title"), F.lit(0)) > 0))


def batch_headlines(snapshots: DataFrame, n: int = FEED_LIMIT, key: str = "ticker",
                    fetch: str = "fetched_at") -> DataFrame:
    """Per ticker and fetch, the list of its headlines in feed order;
    fetches with none are absent.  A list holds at most ``n`` items, so no
    group grows with the history."""
    h = headlines(snapshots, n)
    return (h.groupBy(key, fetch).agg(F.array_sort(F.collect_list(F.struct("pos", "title"))).alias("_h"))
            .select(key, fetch, F.transform("_h", lambda x: x["title"]).alias("headlines")))
