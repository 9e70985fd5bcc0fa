"""Constraint checks (C1-C7) as row filters: every row is kept and tagged,
then split into valid rows and rejects with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketsig.schemas import TableSpec


def surrogate_id(*cols) -> Column:
    """Repeatable id from the natural key (unlike a sequence or uuid())."""
    return F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols])


def url_id(url) -> Column:
    """C7 for news rows: hex SHA-256 of the URL."""
    return F.sha2(F.col(url) if isinstance(url, str) else url, 256)


def fill_defaults(df: DataFrame, spec: TableSpec, as_of) -> DataFrame:
    """The DDL defaults, for columns that are NULL or absent -- an id becomes a hash of the table key
    (sha2 of the URL for news, all other columns where the id itself is the key), a timestamp /
    created_at becomes the as-of time (the reference's NOW())."""
    from marketsig.functions.scalar import time_literal
    out = df
    for f in spec.schema.fields:
        if f.name in ("timestamp", "created_at"):
            now = time_literal(as_of, dict(df.dtypes).get(f.name, f.dataType.simpleString())).cast(f.dataType)
            out = out.withColumn(f.name, F.coalesce(F.col(f.name), now) if f.name in df.columns else now)
    if "id" in spec.schema.names:
        natural = spec.key if spec.key != ("id",) else [c for c in spec.schema.names if c != "id" and c in out.columns]
        new_id = (url_id("url") if spec.name == "news_staging" else surrogate_id(*natural)).cast(spec.schema["id"].dataType)
        out = out.withColumn("id", F.coalesce(F.col("id"), new_id) if "id" in df.columns else new_id)
    return out


def violations(spec: TableSpec) -> list[tuple[str, Column]]:
    """(reason, failing-condition) pairs in a fixed order."""
    out = []
    for c in spec.not_null:
        out.append((f"{c} is null", F.col(c).isNull()))
    for c, vals in spec.allowed.items():
        out.append((f"{c} not in {'/'.join(vals)}", F.col(c).isNotNull() & ~F.col(c).isin(*vals)))
    for c, n in spec.max_len.items():
        out.append((f"{c} longer than {n}", F.length(F.col(c)) > n))
    for c, (p, s) in spec.decimals.items():
        # try_cast gives NULL on overflow; a non-null value that becomes NULL is rejected.
        out.append((f"{c} overflows decimal({p},{s})",
                    F.col(c).isNotNull() & F.col(c).try_cast(f"decimal({p},{s})").isNull()))
    return out


def check(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Add ``valid`` and ``reason`` (all failed checks, ``; ``-joined)."""
    checks = violations(spec)
    reasons = F.concat_ws("; ", *[F.when(cond, F.lit(msg)) for msg, cond in checks])
    return (df.withColumn("reason", F.nullif(reasons, F.lit("")))
            .withColumn("valid", F.col("reason").isNull()))


def split_valid(df: DataFrame, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    """(rows that satisfy every constraint conformed to the table schema,
    rejected rows with their reason)."""
    tagged = check(df, spec)
    good = conform(tagged.filter("valid"), spec)
    bad = tagged.filter(~F.col("valid"))
    return good, bad


def conform(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Round decimal columns to their scale and select the table's columns."""
    cols = []
    for f in spec.schema.fields:
        c = F.col(f.name)
        if f.name in spec.decimals:
            p, s = spec.decimals[f.name]
            c = c.try_cast(f"decimal({p},{s})").cast(f.dataType)
        else:
            c = c.cast(f.dataType)
        cols.append(c.alias(f.name))
    extra = [c for c in spec.partition_by if c in df.columns and c not in spec.schema.names]
    return df.select(*cols, *extra)
