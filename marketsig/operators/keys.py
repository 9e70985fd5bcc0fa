"""Keys, dedup and set logic: insert-ignore (K2, K5, U2, J4), update by key
(K6, J6), source fallback (S8, U1), universe filter (F2, J5) and key audits
(C3, C4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketsig.operators.series import _names

# Literal universes up to this size are broadcast; their size is known.
MAX_LITERAL_BROADCAST = 100_000


def first_per_key(df: DataFrame, keys: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row of each key under ``order`` (first arrival wins).

    Written as ``min_by`` over a struct so Spark aggregates partially before
    the shuffle: a URL copied a million times costs one row per map task.
    """
    keys = _names(keys)
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys)
            .agg(F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("_first"))
            .select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest]))


def insert_ignore(incoming: DataFrame, existing: DataFrame | None, keys: str | Sequence[str],
                  order: Sequence[str]) -> DataFrame:
    """K2/K5: the rows an ``INSERT ... ON CONFLICT (keys) DO NOTHING`` would
    add -- first row per key in the batch, minus keys already stored.  The
    result *is* the set of newly inserted rows."""
    keys = _names(keys)
    fresh = first_per_key(incoming, keys, order)
    if existing is None:
        return fresh
    return fresh.join(existing.select(*keys), keys, "left_anti")


def apply_updates(table: DataFrame, updates: DataFrame, keys: str | Sequence[str],
                  column: str) -> DataFrame:
    """``UPDATE table SET column = u.column WHERE key = u.key``.

    Several updates of one key become one, its largest value, so the table
    never grows; reduce them with ``first_per_key`` first where another one
    should win.
    """
    keys = _names(keys)
    u = updates.groupBy(*keys).agg(F.max(column).alias("_new"))
    cols = [F.coalesce(F.col("_new"), F.col(column)).alias(column) if c == column else F.col(c)
            for c in table.columns]
    return table.join(u, keys, "left").select(*cols)


def fallback(primary: DataFrame, secondary: DataFrame, key: str = "ticker") -> DataFrame:
    """All primary rows, plus secondary rows of keys with no primary row."""
    have = primary.select(key).distinct()
    return primary.unionByName(secondary.join(have, key, "left_anti"), allowMissingColumns=True)


def in_universe(df: DataFrame, column: str | Column, universe, upper: bool = True) -> DataFrame:
    """Keep rows whose (upper-cased) ticker is in the universe.

    A Python list of up to ``MAX_LITERAL_BROADCAST`` names is broadcast; a
    longer one, and a DataFrame universe of unknown size, are left to Spark's
    size-based join choice.
    """
    c = F.col(column) if isinstance(column, str) else column
    c = F.upper(c) if upper else c
    d = df.withColumn("_u", c)
    if isinstance(universe, DataFrame):
        u = universe.select(F.col(universe.columns[0]).alias("_u"))
    else:
        vals = sorted({str(v).upper() if upper else v for v in universe})
        u = d.sparkSession.createDataFrame([(v,) for v in vals], "_u string")
        if len(vals) <= MAX_LITERAL_BROADCAST:
            u = F.broadcast(u)
    return d.join(u, "_u", "left_semi").drop("_u")


def duplicate_keys(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """C3/C4 audit: keys that occur more than once."""
    return df.groupBy(*_names(keys)).count().filter(F.col("count") > 1)
