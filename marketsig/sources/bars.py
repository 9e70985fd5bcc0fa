"""Price-history source (S7): daily OHLCV bars and the look-back slice."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lower_columns(df: DataFrame) -> DataFrame:
    """Column names lower-cased, as the reference does for its bars."""
    return df.toDF(*[c.lower() for c in df.columns])


def lookback(df: DataFrame, ts: str, as_of, months: int = 1) -> DataFrame:
    """Rows with ``ts >= as_of - months``; a literal ``as_of`` is pushed
    into the parquet scan."""
    from marketsig.functions.scalar import time_literal
    a = time_literal(as_of, dict(df.dtypes).get(ts, "timestamp_ntz"))
    return df.filter(F.col(ts) >= a - F.make_ym_interval(F.lit(0), F.lit(months)))


def order_key(df: DataFrame, ts: str, tie: str) -> Column:
    """One fixed-width key that sorts like ``(ts, tie)``: epoch microseconds
    times 2 * 10^19 plus an integral tie-breaker of any sign, as DECIMAL(38,0); a
    NULL tie comes before all others, as in the struct.  With it
    ``min_by``/``max_by`` keep a fixed-width buffer, so Spark aggregates with
    a hash table instead of sorting every map partition (a struct key forces
    the sort-based path).  Falls back to the struct for a non-integral tie."""
    if dict(df.dtypes).get(tie) not in ("bigint", "int", "smallint", "tinyint"):
        return F.struct(F.col(ts), F.col(tie))
    if dict(df.dtypes)[ts] == "timestamp":
        micros = F.unix_micros(F.col(ts))
    else:
        micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")
    d = "decimal(38,0)"
    place = F.coalesce(F.col(tie).cast(d), F.lit(Decimal(-(1 << 63) - 1)).cast(d))
    return micros.cast(d) * F.lit(2 * Decimal(10) ** 19).cast(d) + place


def daily_bars(ticks: DataFrame, key: str, ts: str, price: str, tie: str,
               size: str | None = None) -> DataFrame:
    """S7 from ticks: one bar per key and day.  open/close are the first/last
    price by (ts, tie); volume is the summed size, or the tick count.  All
    aggregates are partial (hash-based, see ``order_key``), so a hot key
    does not skew the shuffle."""
    order = order_key(ticks, ts, tie)
    vol = F.sum(size) if size else F.count(F.lit(1))
    return (ticks.groupBy(key, F.to_date(ts).alias("date"))
            .agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"),
                 F.min(price).alias("low"), F.max_by(price, order).alias("close"),
                 vol.alias("volume")))
