"""Top-k, first-n and as-of history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketsig.operators.series import (CHUNK, DEFAULT_CHUNK_ROWS, IDX, _names, index_series_adaptive, materialize,
                                        over_chunks)
from marketsig.operators.indicators import with_position


def top_k_per_key(df: DataFrame, keys: str | Sequence[str], order: Sequence[Column], k: int,
                  rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key under ``order`` (add a unique
    tie-breaker such as the id).  ``row_number() <= k`` lets Spark run a
    partial WindowGroupLimit before the shuffle, so a hot key ships at most
    ``k`` rows per map task."""
    w = Window.partitionBy(*_names(keys)).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def latest_k(df: DataFrame, keys: str | Sequence[str], order: Sequence[Column], k: int,
             fields: Sequence[str], out: str = "latest") -> DataFrame:
    """T1 + J3 now-mode: per key the first ``k`` rows under ``order`` as an
    array of structs (in that order).  The partial window limit keeps at most
    ``k`` rows per key and task before the shuffle, and each list holds at
    most ``k`` items."""
    keys = _names(keys)
    top = top_k_per_key(df, keys, order, k, rank="_r")
    return (top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", *fields))).alias("_l"))
            .select(*keys, F.transform("_l", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(out)))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Global top ``k`` (TakeOrderedAndProject: per-task top-k, then merge)."""
    return df.orderBy(*order).limit(k)


def first_n_items(df: DataFrame, items: str, n: int, pos: str = "pos",
                  item: str = "item") -> DataFrame:
    """T4: one row per element among the first ``n`` of an array column, in
    feed order (filter applied after the limit, as in the reference)."""
    rest = [c for c in df.columns if c != items]
    return (df.select(*rest, F.posexplode(F.slice(F.col(items), 1, n)).alias(pos, item)))


def history_before(df: DataFrame, keys: str | Sequence[str], ts: str, tie: str, k: int,
                   fields: Sequence[str], out: str = "history", block_unit: str | None = None,
                   chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """For every row, the ``k`` previous rows of its key, newest first, as
    an array of structs of ``fields`` (the as-of history a decision saw).

    A bounded look-back, so it runs on chunks of the series with a ``k``-row
    halo instead of one window per key.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    d = with_position(df, keys, ts, tie, block_unit)

    def compute(fr, w):
        prev = F.collect_list(F.struct(*fields)).over(w.rowsBetween(-k, -1))
        return fr.withColumn(out, F.reverse(prev))
    return over_chunks(d, keys, k, compute, IDX, chunk_rows).drop(IDX)


# Rows of a chunk of the merged timeline: a frame of its window may hold all of them.
ASOF_CHUNK_ROWS = 1 << 17


def _last_k(df: DataFrame, parts: Sequence[str], order: Sequence[Column], k: int, item: str, out: str) -> DataFrame:
    """The newest ``k`` non-NULL ``item``s up to each row of its part, oldest first.

    The range runs over the number of items so far, so it is recomputed once per item, however many rows
    without one lie between.
    """
    so_far = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = Window.partitionBy(*parts).orderBy("_items").rangeBetween(1 - k, 0)
    return df.withColumn("_items", F.count(item).over(so_far)).withColumn(out, F.collect_list(item).over(last)).drop("_items")


def history_asof(decisions: DataFrame, trades: DataFrame, keys: str | Sequence[str], ts: str,
                 decision_id: str, trade_tie: str, k: int, fields: Sequence[str],
                 out: str = "history", chunk_rows: int = ASOF_CHUNK_ROWS) -> DataFrame:
    """J3 back-fill mode: for every decision, the ``k`` latest trades of its
    key strictly before the decision's time, newest first (ties by ``trade_tie``).

    Decisions and trades get their positions in one merged timeline, indexed once and checkpointed;
    at equal times decisions come first.  Inside a chunk of the timeline a running window holds the last
    ``k`` trades.  What a chunk takes over from those before it is the same window over the last ``k`` trades
    of each chunk and one marker a chunk, so a key's rows are never in one task, nor joined with
    each other.  Every decision row comes out once; without a time or key its history is empty, and
    trades without one are in no history.
    """
    if k < 1 or chunk_rows < 1:
        raise ValueError("k and chunk_rows must be at least 1")
    keys = _names(keys)
    types = dict(trades.dtypes)[trade_tie], dict(decisions.dtypes)[decision_id]
    integral = [t in ("bigint", "int", "smallint", "tinyint") for t in types]
    # decisions of one time may come in any order; an integral tie lets a hot time be split
    tie = F.col(trade_tie).cast("long") if integral[0] else F.col(trade_tie)
    own = F.lit(None).cast(types[0])
    if integral[0]:
        own = F.col(decision_id).cast("long") if integral[1] else F.xxhash64(decision_id)
    item, rest = F.struct(*fields), F.struct(*decisions.columns)
    placed = F.col(ts).isNotNull()
    for key in keys:
        placed = placed & F.col(key).isNotNull()

    def side(df: DataFrame, kind: int, tie: Column, trade: Column, row: Column) -> DataFrame:
        return df.filter(placed).select(*keys, ts, F.lit(kind).cast("tinyint").alias("_kind"), tie.alias("_tie"),
                                        trade.alias("_trade"), row.alias("_row"))

    none_row = F.lit(None).cast(decisions.select(rest).schema[0].dataType)
    of_trade = trades.select(item).schema[0].dataType
    none_trade, no_trades = F.lit(None).cast(of_trade), F.array().cast(T.ArrayType(of_trade))
    timeline = side(decisions, 0, own, none_trade, rest).unionByName(side(trades, 1, tie, item, none_row))
    d = index_series_adaptive(timeline, keys, ts, [F.col(ts), F.col("_kind"), F.col("_tie")], size_col="_len",
                              tie=["_kind", "_tie"])
    chunk = lambda c: F.floor(c / F.lit(chunk_rows)).cast("long")
    d = materialize(d.select(*keys, "_kind", "_trade", "_row", IDX, chunk(F.col(IDX)).alias(CHUNK),
                             chunk(F.col("_len") - 1).alias("_last")))
    ends = top_k_per_key(d.filter(f"_kind = 1 and {CHUNK} < _last"), [*keys, CHUNK], [F.col(IDX).desc()], k, "_r")
    markers = d.filter((F.col(IDX) > 0) & (F.col(IDX) % chunk_rows == 0))
    merged = (ends.select(*keys, CHUNK, IDX, "_trade", F.lit(1).alias("_part"))
              .unionByName(markers.select(*keys, CHUNK, IDX, none_trade.alias("_trade"), F.lit(0).alias("_part"))))
    carried = (_last_k(merged, keys, [F.col(IDX), F.col("_part")], k, "_trade", "_before")
               .filter("_part = 0").select(*keys, CHUNK, "_before"))
    here = _last_k(d, [*keys, CHUNK], [F.col(IDX)], k, "_trade", "_here").filter("_kind = 0")
    both = F.concat(F.reverse("_here"), F.reverse(F.coalesce("_before", no_trades)))
    found = here.join(carried, [*keys, CHUNK], "left").select("_row.*", F.slice(both, 1, k).alias(out))
    alone = decisions.filter(~placed).withColumn(out, no_trades)
    return found.unionByName(alone.select(*found.columns))
