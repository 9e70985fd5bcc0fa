"""Helpers shared by the corpus operators: word hashing, sampling, intermediate tables."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketsig.session import scratch_path

#: Characters handled at once inside a task, so that numpy temporaries stay small.
SLICE_CHARS = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Byte tables for ``word_hashes``: A-Z become a-z and separators a space.  PLAIN separates at
#: ASCII white space only, LETTERS at every ASCII character that is no letter, digit or underscore.
PLAIN = bytes(32 if c in b" \t\n\r\x0b\x0c" else c + 32 if 65 <= c <= 90 else c for c in range(256))
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() or c == 95 else 32 for c in range(256))
_MASK = (1 << 64) - 1
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
#: Bytes whose powers of the factor are kept; longer buffers are hashed in blocks of so many.
BLOCK = 1 << 17


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS, INVERSES = _powers(_FACTOR), _powers(_INVERSE)


def word_hashes(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and where each text's begin (one more at the end).

    The bytes of a word are the digits of a number modulo 2**64; prefix sums over the whole
    buffer, block by block, give every word's number at once, whatever its place.
    """
    buffer = b" ".join(texts).translate(table)
    u8 = np.frombuffer(buffer, np.uint8)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    if not len(u8):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    inside = np.zeros(len(u8) + 2, np.int8)
    inside[1:-1] = u8 != 32
    edges = np.flatnonzero(np.diff(inside))
    sums = np.zeros(len(edges), np.uint64)  # of the digits before each edge
    inverse = np.ones(len(edges), np.uint64)
    before, at = 0, 0
    for start in range(0, len(u8), BLOCK):
        block = u8[start: start + BLOCK]
        local = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(block * POWERS[: len(block)], out=local[1:])
        scale = pow(_FACTOR, start, 1 << 64)
        upto = int(np.searchsorted(edges, start + len(block), "right"))
        own = edges[at:upto] - start
        sums[at:upto] = local[own] * np.uint64(scale) + np.uint64(before)
        inverse[at:upto] = INVERSES[own] * np.uint64(pow(_INVERSE, start, 1 << 64))
        before, at = (before + scale * int(local[-1])) & _MASK, upto
    first, last = edges[0::2], edges[1::2]
    h = (sums[1::2] - sums[0::2]) * inverse[0::2]
    return mix(h + (last - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), np.searchsorted(first, begins)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words, from the words' hashes in order."""
    if len(h) < n:
        return h[:0]
    end = len(h) - n + 1
    out = h[:end].copy()
    for k in range(1, n):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += h[k: end + k]
    return mix(out)


def flat_ngrams(h: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram hashes of many texts, from ``word_hashes``, and where each text's begin."""
    counts = np.diff(words)
    runs = np.maximum(counts - n + 1, 0)
    starts = np.concatenate([[0], np.cumsum(runs)])
    if not starts[-1]:
        return h[:0], starts
    grams = ngrams(h, n)
    if len(runs) > 1:  # without the runs that cross from one text into the next
        grams = grams[np.arange(starts[-1]) + np.repeat(words[:-1] - starts[:-1], runs)]
    return grams, starts


def slices(texts: list) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` of about SLICE_CHARS each (one longer text stays whole)."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE_CHARS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores added until no column (in any case) has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def parts(batch: pa.RecordBatch, *columns: str, size: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about ``size`` bytes in ``columns`` (one longer row stays whole)."""
    each = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy().astype(np.int64) for c in columns)
    of = (np.cumsum(each) - each) // size
    cuts = [0, *(1 + np.flatnonzero(np.diff(of))).tolist(), batch.num_rows]
    for begin, end in zip(cuts, cuts[1:]):
        yield batch.slice(begin, end - begin)


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def local_path(spark: SparkSession) -> None:
    """Let Python workers of a local session find this package from any working folder."""
    sc = spark.sparkContext
    known = sc.environment.get("PYTHONPATH", "")
    if sc.master.startswith("local") and ROOT not in known.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    local_path(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables stored in each open ``scratch``, the innermost last.
_made: ContextVar[tuple[list[tuple[SparkSession, str]], ...]] = ContextVar("made", default=())
#: Ends a write by removing its shuffle files, which otherwise stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def scratch() -> Iterator[None]:
    """Tables stored inside are deleted at its end, without those that outlive it."""
    token = _made.set((*_made.get(), []))
    try:
        yield
    finally:
        mine = _made.get()[-1]
        _made.reset(token)
        for spark, path in mine:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    except Exception:  # noqa: BLE001 - Spark Connect: files are the server's, and stay
        return
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).delete(folder, True)


def stored(df: DataFrame, name: str, outlives: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    The table goes with the ``scratch`` it is in, of several the one that is so many levels out; without one it stays.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    scopes = _made.get()
    if outlives < len(scopes):
        scopes[-1 - outlives].append((spark, path))
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text leaves no remainder by 5 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``max_rows`` labelled ids, chosen by the hash of the id.

    Held-out ids and null labels never appear; an id labelled twice takes the larger label, one with
    several rows the least of their texts.
    """
    ids = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
           .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
            .join(F.broadcast(ids), "doc_id")  # at most max_rows ids
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")))
