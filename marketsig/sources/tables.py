"""Reading the landed test tables (one parquet file or folder per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Parquet scan of ``{root}/{name}.parquet``; Catalyst prunes columns and
    pushes filters into it."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def newest(df: DataFrame, column: str):
    """The newest value of a time column, as a driver-side literal.

    One single-row aggregate; passing its result as a literal (rather than a
    scalar subquery) lets look-back filters reach the parquet scan as pushed
    predicates, so files and row groups older than the window are skipped.
    """
    from pyspark.sql import functions as F
    return df.agg(F.max(column)).first()[0]
