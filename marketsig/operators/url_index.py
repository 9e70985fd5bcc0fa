"""R2 / K5: an index of stored keys (URLs), so that a batch reads only what may hold its keys.

A key belongs to one of ``BUCKETS`` folders by its hash.  Beside the keys of a batch, each bucket has a
Bloom filter of 64-bit words: a key sets ``PROBES`` bits of one word, and only words with a bit set are
stored, as rows (bucket, word, bits).  A lookup joins its keys with the words of its own buckets; only
buckets in which some key has all its bits are then read and compared exactly.  So a batch of unseen
keys reads words and nothing else, and a false hit costs a read but never changes a result.

Everything written by a batch lies in ``batch_id=N`` folders, which a replay replaces as a whole.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1024
WORDS = 1 << 16
PROBES = 5

_URLS = "key string, batch_id long, bucket int"
_BITS = "word int, bits long, batch_id long, bucket int"


def _hashed(keys: DataFrame, key: str) -> DataFrame:
    """The distinct non-null keys with their bucket, word and bits."""
    h, g = F.xxhash64("key"), F.xxhash64("key", F.lit(1))
    mask = F.lit(0).cast("long")
    for k in range(PROBES):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"),
                                              F.shiftright(g, 6 * k).bitwiseAND(F.lit(63)).cast("int")))
    return (keys.select(F.col(key).cast("string").alias("key")).filter("key is not null").distinct()
            .select("key", F.pmod(h, F.lit(BUCKETS)).cast("int").alias("bucket"),
                    F.pmod(F.shiftright(h, 20), F.lit(WORDS)).cast("int").alias("word"), mask.alias("bits")))


def _read(spark: SparkSession, root: str, part: str, schema: str) -> DataFrame | None:
    """A part of the index, or None where nothing is stored yet."""
    try:
        return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{part}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def add(keys: DataFrame, root: str, key: str, batch_id: int) -> None:
    """Store the keys of a batch; words first, so a batch that dies in between is found again by its replay."""
    h = _hashed(keys, key)
    words = h.groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
    for part, rows in (("words", words), ("keys", h.select("key", "bucket"))):
        (rows.repartition("bucket").sortWithinPartitions("bucket", "word" if part == "words" else "key")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{root.rstrip('/')}/{part}/batch_id={batch_id}"))


def touched(keys: DataFrame, root: str, key: str, but: int | None = None) -> list[int]:
    """The buckets that may hold one of the keys: at most ``BUCKETS`` numbers."""
    words = _read(keys.sparkSession, root, "words", _BITS)
    if words is None:
        return []
    if but is not None:
        words = words.filter(F.col("batch_id") != but)
    h = _hashed(keys, key).select("bucket", "word", F.col("bits").alias("mask"))
    hits = words.join(h, ["bucket", "word"]).filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    return sorted(r.bucket for r in hits.select("bucket").distinct().collect())


def stored_among(keys: DataFrame, root: str, key: str, but: int | None = None) -> DataFrame | None:
    """(key): stored keys out of the buckets that may hold one of ``keys``; None when no bucket may.

    ``but`` leaves out the batch that is being replayed.  A null key is never stored.
    """
    buckets = touched(keys, root, key, but)
    if not buckets:
        return None
    stored = _read(keys.sparkSession, root, "keys", _URLS).filter(F.col("bucket").isin(buckets))
    if but is not None:
        stored = stored.filter(F.col("batch_id") != but)
    return stored.select(F.col("key").alias(key))


def compact(spark: SparkSession, root: str, target: str) -> None:
    """The same index as one batch (number -1) under ``target``: one file and one filter a bucket."""
    keys = _read(spark, root, "keys", _URLS)
    if keys is not None:
        add(keys, target, "key", -1)
