"""Ordered-series plumbing that never puts a whole series into one task.

A ticker may hold a third of all rows, so ``Window.partitionBy('ticker')``
over the raw rows would sort that third in a single task.  Instead:

* ``index_series`` gives every row its 0-based position in its series.  Rows
  are ranked inside coarse *blocks* (a time bucket that only grows along the
  order, e.g. the day), and each block's offset comes from a running sum over
  the per-block counts -- one small row per block, not per event.
* ``over_chunks`` cuts each series into chunks of ``chunk_rows`` consecutive
  positions and copies the last ``lookback`` rows of every chunk into the next
  one (a halo).  Any window that looks back at most ``lookback`` rows is then
  exact inside ``partitionBy(key, chunk)``, and chunks spread a hot series
  over as many tasks as it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDX = "_pos"
CHUNK = "_chunk"

# Default chunk size: large enough that ordinary series are a single chunk,
# small enough that one chunk sorts comfortably inside one task.
DEFAULT_CHUNK_ROWS = 1 << 20


def _names(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _rank_with_offsets(d: DataFrame, keys: list[str], order: Sequence[Column], blk: str,
                       sizes: DataFrame, idx_col: str, size_col: str | None) -> DataFrame:
    """Rank rows inside their block, add the block's offset in the series."""
    local = d.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*keys, blk).orderBy(*order)) - 1)
    before = Window.partitionBy(*keys).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_n").over(Window.partitionBy(*keys)).alias(size_col)] if size_col else []
    offsets = sizes.select(*keys, blk, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), *extra)
    return (local.join(offsets, [*keys, blk])
            .withColumn(idx_col, F.col("_off") + F.col("_rn"))
            .drop("_rn", "_off", blk))


def index_series(df: DataFrame, keys: str | Sequence[str], order: Sequence[Column],
                 block: Column, idx_col: str = IDX, size_col: str | None = None) -> DataFrame:
    """Add ``idx_col`` = 0-based position of each row in its series (and the
    series length as ``size_col`` when given), with a fixed block expression.

    ``order`` must be a total order inside a series (add a unique tie-breaker);
    ``block`` must be non-decreasing along ``order`` (e.g. ``to_date(ts)``).
    """
    keys = _names(keys)
    blk = "_blk"
    d = df.withColumn(blk, block)
    # Block sizes as a map-side partial count: a small shuffle of one row per
    # block and task, not a second shuffle of the rows.
    sizes = d.groupBy(*keys, blk).agg(F.count(F.lit(1)).alias("_n"))
    return _rank_with_offsets(d, keys, order, blk, sizes, idx_col, size_col)


# A block holding more rows than this is split into finer buckets.
MAX_BLOCK_ROWS = 1 << 22
UNITS = ("day", "hour", "minute", "second")
UNIT_SECONDS = {"day": 86400, "hour": 3600, "minute": 60, "second": 1}
# Refinement levels below a day, in microseconds: hour, minute, second,
# millisecond, then the exact timestamp.
_SUB_DAY_MICROS = (3_600_000_000, 60_000_000, 1_000_000, 1_000, 1)


def _micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970, zone-free (wall-clock columns read as UTC)."""
    if dict(df.dtypes)[ts] == "timestamp":
        return F.unix_micros(F.col(ts))
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")


def _bucket(df: DataFrame, ts: str, unit: str) -> Column:
    """Whole ``unit``s since 1970 -- zone-free and non-decreasing in time
    (``date_trunc`` on a wall-clock column goes through the session zone)."""
    return F.floor(_micros(df, ts) / F.lit(UNIT_SECONDS[unit] * 1_000_000)).cast("long")


INTEGRAL = ("bigint", "int", "smallint", "tinyint")


def _levels(df: DataFrame, ts: str, tie: str | Sequence[str] | None) -> list[Column]:
    """Bucket expressions, each refining the previous and non-decreasing
    along (ts, tie, ...): day, hour, minute, second, millisecond, timestamp, and
    for integral tie-breakers (up to the first other one) tie ranges and the tie itself."""
    micros = _micros(df, ts)
    out = [F.floor(micros / F.lit(86_400_000_000)).cast("long")]
    out += [F.floor(micros / F.lit(m)).cast("long") for m in _SUB_DAY_MICROS[:-1]] + [micros.cast("long")]
    types = dict(df.dtypes)
    for name in _names(tie or []):
        if types.get(name) not in INTEGRAL:
            break
        t = F.col(name).cast("long")
        out += [t] if types[name] == "tinyint" else [F.shiftright(t, 20), F.shiftright(t, 10), t]
    return out


def index_series_adaptive(df: DataFrame, keys: str | Sequence[str], ts: str, order: Sequence[Column],
                          idx_col: str = IDX, size_col: str | None = None,
                          max_block_rows: int = MAX_BLOCK_ROWS, tie: str | Sequence[str] | None = None) -> DataFrame:
    """``index_series`` with blocks sized to the data.

    Rows are counted per (series, day) once -- a partial aggregate, kept as
    a small checkpoint because it is also the block-size table.  When no day
    holds more than ``max_block_rows`` rows (one tiny check), days are the
    blocks.  Otherwise a hot day is split into hours, a hot hour into
    minutes, and so on down to single timestamps and -- with an integral
    ``tie`` -- tie ranges and single rows, so any hot group splits.  The hot
    lists are broadcast; each holds at most total rows / ``max_block_rows``
    entries, so their size is bounded by construction.  ``order`` must be
    ``(ts, tie)`` when ``tie`` is given (one column or several), and start with ``ts`` otherwise.
    """
    keys = _names(keys)
    levels = _levels(df, ts, tie)
    lv = [f"_b{i}" for i in range(len(levels))]
    c0 = materialize(df.groupBy(*keys, levels[0].alias(lv[0])).agg(F.count(F.lit(1)).alias("_n")))
    if c0.filter(F.col("_n") > max_block_rows).isEmpty():
        d = df.withColumn("_blk", levels[0])
        return _rank_with_offsets(d, keys, order, "_blk", c0.withColumnRenamed(lv[0], "_blk"),
                                  idx_col, size_col)

    d = df
    for name, expr in zip(lv, levels):
        d = d.withColumn(name, expr)
    # Counts per level, grouped by the whole level prefix, over the rows of
    # hot parents only (AQE skips a level once a hot list comes back empty).
    counts, hots, cur = [c0], [], d
    for i in range(1, len(lv)):
        hot = counts[i - 1].filter(F.col("_n") > max_block_rows).select(*keys, *lv[:i])
        hots.append(hot)
        cur = cur.join(F.broadcast(hot), [*keys, *lv[:i]], "left_semi")
        counts.append(cur.groupBy(*keys, *lv[:i + 1]).agg(F.count(F.lit(1)).alias("_n")))
    # A row's block: each level's bucket while its parent is hot, a constant
    # below that (the same for every row of an unsplit bucket).
    for i, hot in enumerate(hots):
        d = d.join(F.broadcast(hot.withColumn(f"_h{i}", F.lit(True))), [*keys, *lv[:i + 1]], "left")
    unset = F.lit(-1).cast("long")
    parts = [F.col(lv[0])] + [F.when(F.col(f"_h{i - 1}").isNotNull(), F.col(lv[i])).otherwise(unset)
                              for i in range(1, len(lv))]
    d = (d.withColumn("_blk", F.struct(*[p.alias(f"l{j}") for j, p in enumerate(parts)]))
         .drop(*lv, *[f"_h{i}" for i in range(len(hots))]))
    # Block sizes: each level's counts for buckets that were not split.
    sizes = None
    for i, c in enumerate(counts):
        if i < len(hots):
            c = c.join(F.broadcast(hots[i]), [*keys, *lv[:i + 1]], "left_anti")
        fields = [F.col(lv[j]).alias(f"l{j}") if j <= i else unset.alias(f"l{j}") for j in range(len(lv))]
        part = c.select(*keys, F.struct(*fields).alias("_blk"), "_n")
        sizes = part if sizes is None else sizes.unionByName(part)
    return _rank_with_offsets(d, keys, order, "_blk", sizes, idx_col, size_col)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage where a frame feeds several branches: a reliable
    checkpoint under ``spark.checkpoint.dir`` (shared storage on a cluster, so
    a lost executor does not lose it)."""
    from marketsig.session import checkpoint_root
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def over_chunks(df: DataFrame, keys: str | Sequence[str], lookback: int,
                compute: Callable[[DataFrame, Window], DataFrame],
                idx_col: str = IDX, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Evaluate windowed columns that look back at most ``lookback`` rows.

    ``compute(frame, w)`` receives the chunked frame and the window
    ``partitionBy(*keys, chunk).orderBy(idx_col)`` and returns the frame with
    its new columns.  Halo copies are removed afterwards, so each input row
    comes out exactly once.
    """
    if not 0 <= lookback < chunk_rows:
        raise ValueError("lookback must be below chunk_rows")
    keys = _names(keys)
    pos = F.col(idx_col)
    own = F.floor(pos / F.lit(chunk_rows)).cast("long")
    in_halo = (pos % F.lit(chunk_rows)) >= F.lit(chunk_rows - lookback)
    targets = F.when(F.lit(lookback > 0) & in_halo, F.array(own, own + 1)).otherwise(F.array(own))
    framed = (df.withColumn("_own", own)
              .withColumn(CHUNK, F.explode(targets)))
    w = Window.partitionBy(*keys, CHUNK).orderBy(idx_col)
    out = compute(framed, w)
    return out.filter(F.col(CHUNK) == F.col("_own")).drop(CHUNK, "_own")
