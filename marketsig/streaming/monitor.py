"""Streaming versions of the news plan.

* R1 ``monitor``: the whole batch plan every 15 minutes via ``foreachBatch``;
  tests and back-fills use ``availableNow``.
* R2/R3 ``insert_new_articles``: exact URL insert-ignore per micro-batch
  against the stored table, scoring only the inserted rows; writes are
  idempotent by batch id (K7), so a replayed batch after a failure
  overwrites its own output instead of duplicating it.
  ``dedup_within_watermark`` is the bounded-state alternative.
* R4/R5 ``sliding_scores`` / ``alerts``: 1-hour windows sliding every 15
  minutes, weight 2 for rows in the last 15 minutes of the window; append
  mode emits a window once the watermark passes its end.
* R6: rows are bucketed by ingest time, so nothing is late by default; the
  watermark delay is a parameter for publish-time mode.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketsig.operators import keys, sentiment, url_index
from marketsig.session import scratch_path

# The reference polls every 15 minutes over the last hour.
POLL = "15 minutes"
WINDOW = "1 hour"
WATERMARK = "10 minutes"


_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def event_time(df: DataFrame, column: str, out: str = "event_time") -> DataFrame:
    """Watermarks need TIMESTAMP; a wall-clock (NTZ) column is read as UTC by
    epoch arithmetic, independent of the session time zone."""
    c = F.col(column)
    if dict(df.dtypes)[column] == "timestamp_ntz":
        c = F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, {_EPOCH_NTZ}, `{column}`)"))
    return df.withColumn(out, c)


def wall_clock(c) -> "F.Column":
    """Inverse of ``event_time``: a UTC instant as a TIMESTAMP_NTZ wall clock."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.expr(_EPOCH_NTZ))


def sliding_scores(stream: DataFrame, key: str, at: str, score: str, window: str = WINDOW,
                   slide: str = POLL, recent_minutes: int = sentiment.RECENT_MINUTES,
                   watermark: str = WATERMARK) -> DataFrame:
    """Weighted score per key and sliding window (A6 on a stream).

    The window is added as a column first so the weight can refer to its end.
    """
    s = stream.withWatermark(at, watermark).withColumn("window", F.window(at, window, slide))
    s = s.withColumn("_w", F.when(F.col(at) >= F.col("window.end") - F.expr(f"INTERVAL {recent_minutes} MINUTES"),
                                  2.0).otherwise(1.0))
    agg = (s.filter(F.col(score).isNotNull())
           .groupBy(key, "window")
           .agg(sentiment.exact_sum(F.col(score) * F.col("_w")).alias("_sw"), F.sum("_w").alias("_tw"),
                F.count(F.lit(1)).alias("articles_count")))
    agg = agg.withColumn("raw_score", F.coalesce(F.try_divide("_sw", "_tw"), F.lit(0.0))).drop("_sw", "_tw")
    return sentiment.alert_columns(agg)


def alerts(scores: DataFrame) -> DataFrame:
    """Only the windows whose (unrounded) score crossed the threshold."""
    return scores.filter(F.col("alert"))


def dedup_within_watermark(stream: DataFrame, key: str = "url", at: str = "event_time",
                           watermark: str = "1 hour") -> DataFrame:
    """R2 with bounded state: drop repeats of a key seen within the watermark."""
    return stream.withWatermark(at, watermark).dropDuplicatesWithinWatermark([key])


def dedup_exact_state(stream: DataFrame, key: str = "url") -> DataFrame:
    """R2 exact, incremental: every key ever seen is kept in the state store
    (no watermark), so each URL is emitted once across all batches without
    re-reading the stored table.  State grows with the number of distinct
    URLs -- use the RocksDB state store provider for large state.  Among
    copies arriving in the same micro-batch one is kept, not necessarily the
    first in feed order; ``insert_new_articles`` keeps the first."""
    return stream.dropDuplicates([key])


def batch_writer(path: str, partition_by: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """K7: write each micro-batch to ``path/batch_id=N``; a replay of the same
    batch replaces its own folder, so the sink is idempotent."""
    def write(df: DataFrame, batch_id: int) -> None:
        w = df.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(f"{path.rstrip('/')}/batch_id={batch_id}")
    return write


def insert_new_articles(stream: DataFrame, table_path: str, score: Callable[[DataFrame], DataFrame],
                        key: str = "url", order: Sequence[str] = ("created_at",),
                        checkpoint: str | None = None, available_now: bool = True,
                        index: str | None = None) -> StreamingQuery:
    """R2/R3 exact: every micro-batch is insert-ignored against the stored
    table (K5), only the inserted rows are scored (E1), and they are
    appended idempotently (K7).  With ``index``, the folder of a
    ``url_index``, a batch reads only the index buckets that may hold its
    keys instead of the stored table's whole key column."""
    spark = stream.sparkSession

    def run(batch: DataFrame, batch_id: int) -> None:
        if index is not None:
            stored = url_index.stored_among(batch, index, key, but=batch_id)
        else:
            stored = _read_or_none(spark, table_path)
            if stored is not None:
                stored = stored.filter(F.col("batch_id") != batch_id)   # a replay ignores its own output
        fresh = keys.insert_ignore(batch, stored, key, list(order))
        batch_writer(table_path)(score(fresh), batch_id)
        if index is not None:
            written = spark.read.parquet(f"{table_path.rstrip('/')}/batch_id={batch_id}")
            url_index.add(written, index, key, batch_id)

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation",
                                                     checkpoint or scratch_path(spark, "ckpt-dedup"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=POLL)
    return w.start()


def monitor(stream: DataFrame, run_batch: Callable[[DataFrame, int], None], checkpoint: str,
            available_now: bool = False) -> StreamingQuery:
    """Run ``run_batch(batch_df, batch_id)`` on every poll (15 minutes)."""
    w = stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=POLL)
    return w.start()


def run_to_table(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """Drain a stream with ``availableNow`` into a parquet table under the
    checkpoint root and return that table (lineage cut by the write)."""
    out = scratch_path(spark, name)
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{out}/data")
         .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{out}/data")


def _read_or_none(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    try:
        r = spark.read.schema(schema) if schema is not None else spark.read
        return r.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None  # no table yet


def news_monitor(stream: DataFrame, table_path: str, signals_path: str,
                 score: Callable[[DataFrame], DataFrame], universe: DataFrame, checkpoint: str,
                 stored_schema, key: str = "ticker", order: Sequence[str] = ("created_at", "pos"),
                 lookback_minutes: int = sentiment.LOOKBACK_MINUTES,
                 recent_minutes: int = sentiment.RECENT_MINUTES,
                 available_now: bool = False) -> StreamingQuery:
    """R1 + P1 + R2/R3 + K7: every poll runs the news plan on the landed
    articles of the micro-batch against the stored table.

    Per batch: new URLs are inserted (scored once) into ``table_path`` and
    the per-ticker signals, as of the newest ingest time of the batch, go
    to ``signals_path``; both writes are keyed by the batch id, so a replay
    after a failure rewrites the same folders.  ``stream`` rows carry
    ``key, url, headline, created_at, published_at, pos, source``.
    """
    from marketsig.plans import news as news_plan
    from marketsig.sources.news import PRIMARY
    spark = stream.sparkSession

    def run(batch: DataFrame, batch_id: int) -> None:
        stored = _read_or_none(spark, table_path, stored_schema)
        if stored is not None:
            stored = stored.filter(F.col("batch_id") != batch_id).drop("batch_id")
        else:
            stored = spark.createDataFrame([], stored_schema).drop("batch_id")
        as_of = batch.agg(F.max("created_at")).first()[0]
        if as_of is None:
            return
        primary = batch.filter(F.col("source") == PRIMARY)
        secondary = batch.filter(F.col("source") != PRIMARY)
        fetched, inserted = news_plan.ingest(primary, secondary, stored, score, key, order)
        batch_writer(table_path)(inserted, batch_id)
        new_rows = spark.read.parquet(f"{table_path.rstrip('/')}/batch_id={batch_id}")
        signals = news_plan.signals_from(stored.unionByName(new_rows), fetched, as_of, universe, key,
                                         lookback_minutes, recent_minutes)
        from marketsig.functions.scalar import time_literal
        batch_writer(signals_path)(signals.withColumn("as_of", time_literal(as_of, dict(batch.dtypes)["created_at"])),
                                   batch_id)

    return monitor(stream, run, checkpoint, available_now)


def daily_bars_stream(stream: DataFrame, key: str, at: str, price: str, tie: str,
                      watermark: str = WATERMARK) -> DataFrame:
    """S7 on a stream: OHLCV bars per key and day from ticks; a day's bar is
    emitted once the watermark passes the end of the day (append mode).
    Aggregates are the batch bar's (``sources.bars.daily_bars``)."""
    from marketsig.sources.bars import order_key
    order = order_key(stream, at, tie)
    return (stream.withWatermark(at, watermark)
            .groupBy(key, F.window(at, "1 day").alias("day"))
            .agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"),
                 F.min(price).alias("low"), F.max_by(price, order).alias("close"),
                 F.count(F.lit(1)).alias("volume")))
