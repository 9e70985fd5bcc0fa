"""Sinks: the four tables as date-partitioned parquet (K1), validated bulk
appends (K3, K4), insert-ignore appends (K2, K5), score updates (K6) and
idempotent stream batches (K7, in ``streaming.monitor``).

A table is a folder ``{root}/{name}`` partitioned by ``dt`` (the row's
date), so filters on ``dt`` prune whole partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketsig.operators import keys
from marketsig.operators.validate import split_valid
from marketsig.schemas import TABLES, TableSpec
from marketsig.session import scratch_path

DATE_COLUMN = {"market_quotes": "timestamp", "sentiment_scores": "timestamp", "trade_ledger": "timestamp",
               "news_staging": "created_at"}


def table_path(root: str, spec: TableSpec) -> str:
    return f"{root.rstrip('/')}/{spec.name}"


def _with_dt(df: DataFrame, spec: TableSpec) -> DataFrame:
    return df.withColumn("dt", F.to_date(F.col(DATE_COLUMN[spec.name])))


def stored_schema(spec: TableSpec) -> T.StructType:
    return T.StructType(spec.schema.fields + [T.StructField("dt", T.DateType())])


def create_tables(spark: SparkSession, root: str, specs: Sequence[TableSpec] = tuple(TABLES.values())) -> dict:
    """K1: create every table that does not exist yet (idempotent)."""
    paths = {}
    for spec in specs:
        schema = stored_schema(spec)
        path = table_path(root, spec)
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy("dt").parquet(path)
        paths[spec.name] = path
    return paths


def read_table(spark: SparkSession, root: str, spec: TableSpec) -> DataFrame:
    """The table with its fixed schema (never inferred)."""
    return spark.read.schema(stored_schema(spec)).parquet(table_path(root, spec))


def append(df: DataFrame, root: str, spec: TableSpec) -> DataFrame:
    """K3/K4: validate (C1-C7), append the valid rows, return the rejects."""
    good, bad = split_valid(df, spec)
    _with_dt(good, spec).write.mode("append").partitionBy("dt").parquet(table_path(root, spec))
    return bad


def insert_ignore_into(df: DataFrame, root: str, spec: TableSpec, order: Sequence[str]) -> DataFrame:
    """K2/K5: append the valid rows whose key is new (first per key in the
    batch); returns the rows written, read back from a checkpointed copy so
    the caller's later reads do not re-run against the grown table.  Rows
    that break a constraint take no key and are not written: ``split_valid``
    gives them."""
    spark = df.sparkSession
    stored = read_table(spark, root, spec)
    good, _ = split_valid(df, spec)
    fresh = keys.insert_ignore(good, stored.select(*spec.key), list(spec.key), list(order))
    staged = scratch_path(spark, f"{spec.name}-insert")
    fresh.write.parquet(staged)
    fresh = spark.read.parquet(staged)
    append(fresh, root, spec)
    return fresh


def update_scores(spark: SparkSession, root: str, updates: DataFrame, spec: TableSpec = TABLES["news_staging"],
                  column: str = "sentiment_score") -> None:
    """K6: ``UPDATE ... SET column WHERE key`` by rewriting only the date
    partitions that hold an updated key.  The new partitions are staged
    under the checkpoint root first, because a path cannot be overwritten
    while the same job reads it."""
    table = read_table(spark, root, spec)
    touched = table.join(updates.select(*spec.key), list(spec.key), "left_semi").select("dt").distinct()
    part = table.join(touched, "dt", "left_semi")
    new = keys.apply_updates(part, updates, list(spec.key), column)
    staged = scratch_path(spark, f"{spec.name}-update")
    new.write.partitionBy("dt").parquet(staged)
    (spark.read.schema(stored_schema(spec)).parquet(staged).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(table_path(root, spec)))


def ddl(spec: TableSpec, root: str) -> str:
    """K1 as SQL: ``CREATE TABLE IF NOT EXISTS`` over the table's folder."""
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored_schema(spec).fields)
    return (f"CREATE TABLE IF NOT EXISTS {spec.name} ({cols}) USING parquet PARTITIONED BY (dt) "
            f"LOCATION '{table_path(root, spec)}'")


def register_tables(spark: SparkSession, root: str,
                    specs: Sequence[TableSpec] = tuple(TABLES.values())) -> None:
    """Create the folders if needed and register each table in the session
    catalog, so ``spark.sql('SELECT ... FROM trade_ledger')`` works; new
    date partitions written later are picked up with ``MSCK REPAIR TABLE``
    (done here once)."""
    create_tables(spark, root, specs)
    for spec in specs:
        spark.sql(ddl(spec, root))
        spark.sql(f"MSCK REPAIR TABLE {spec.name}")
