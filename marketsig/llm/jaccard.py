"""N-gram Jaccard join: documents linked by the Jaccard similarity of their word shingles.

A document's distinct shingles are ordered rare first.  Two sets of similarity t or more share a
shingle among the first |set| - ceil(t |set|) + 1 of each (prefix filter); the shared prefix
shingle's places (positional filter), the sizes (length filter) and the parities of the shingle counts by
hash class (suffix filter: each class of unequal parity holds a shingle that only one set has) rule
out most pairs before each remaining one is verified once by its whole sets.

Any order gives the same links; rare first only keeps candidates few.  Frequencies come from a
fixed-size table of counts over all shingles of all documents, each counted in the entry its hash
picks, so that a shingle's count is never too low.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketsig.llm.common import PLAIN, flat_ngrams, ngrams, parts, scratch, slices, stored, texts_of, word_hashes
from marketsig.llm.linking import groups, with_ids

PARTS = 64  # rows that the count table is summed in


@dataclass(frozen=True)
class Settings:
    """Words of a shingle, least similarity in percent, log2 of the count table's size; bits of a
    parity sketch at most (a set has about as many as shingles)."""

    words: int = 4
    percent: int = 85
    count_bits: int = 18
    parity_bits: int = 1 << 20


def shingle_sets(texts: list[str], n: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, sorted; a text of fewer words is one shingle."""
    for begin, end in slices(texts):
        h, words = word_hashes([t.encode() for t in texts[begin:end]], PLAIN)
        grams, starts = flat_ngrams(h, words, n)
        for i in range(end - begin):
            own = grams[starts[i]: starts[i + 1]]
            if not len(own) and words[i + 1] > words[i]:
                own = ngrams(h[words[i]: words[i + 1]], int(words[i + 1] - words[i]))
            yield np.unique(own)


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """(id, n_shingles, digest) of every row; equal sets have equal digests."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, "text")):
            sets = [(len(x), hash_of(x)) for x in shingle_sets(texts_of(batch), s.words)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([n for n, _ in sets], pa.int64()), pa.array([d for _, d in sets], pa.binary())],
                                             names=["id", "n_shingles", "digest"])
    return docs.mapInArrow(task, "id long, n_shingles long, digest binary")


def hash_of(values: np.ndarray) -> bytes:
    from hashlib import blake2b
    return blake2b(values.tobytes(), digest_size=16).digest()


def count_table(docs: DataFrame, s: Settings) -> np.ndarray:
    """How many documents' shingles fall in each entry, over all documents; its size is fixed."""
    size = 1 << s.count_bits

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in (part for whole in batches for part in parts(whole, "text")):
            for x in shingle_sets(texts_of(batch), s.words):
                np.add.at(total, (x >> np.uint64(64 - s.count_bits)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS), pa.int32()), pa.array([p.tobytes() for p in total.reshape(PARTS, -1)], pa.binary())],
                                         names=["part", "counts"])

    def add(keys: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = sum(np.frombuffer(c, np.int64) for f in frames for c in f["counts"])
        yield pd.DataFrame({"part": [keys[0]], "counts": [total.tobytes()]})

    rows = docs.select("text").mapInArrow(task, "part int, counts binary").groupBy("part").applyInPandas(add, "part int, counts binary").collect()
    out = np.zeros((PARTS, size // PARTS), np.int64)
    for r in rows:
        out[r.part] = np.frombuffer(bytes(r.counts), np.int64)
    return out.reshape(-1)


def parity(x: np.ndarray, s: Settings) -> bytes:
    """One bit per hash class: whether it holds an odd number of the set's shingles."""
    bits = 64
    while bits < min(len(x), s.parity_bits):
        bits *= 2
    odd = np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A bound from below on the shingles that only one of two sets has, from their sketches."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def prefixes(docs: DataFrame, counts: np.ndarray, s: Settings) -> DataFrame:
    """(id, size, parity, keys): the rare-first prefix of every non-empty set and its parity sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # of fixed size

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in (part for whole in batches for part in parts(whole, "text")):
            ids, rows = batch.column("id").to_pylist(), []
            for i, x in zip(ids, shingle_sets(texts_of(batch), s.words)):
                if not len(x):
                    continue
                length = len(x) - -(-s.percent * len(x) // 100) + 1
                rare = table[(x >> np.uint64(64 - s.count_bits)).astype(np.int64)]
                first = np.lexsort((x, rare))[:length]
                rows.append((i, len(x), parity(x, s), x[first].view(np.int64)))
            kinds = pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(4)], names=["id", "size", "parity", "keys"])

    return docs.mapInArrow(task, "id long, size int, parity binary, keys array<long>")


def linked(docs: DataFrame, pairs: DataFrame, sizes: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the limit: length and suffix filters, then whole sets."""
    for side in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("id").alias(side), F.col("size").alias(f"n{side}"), F.col("parity").alias(f"p{side}")), side)
    near = pairs.filter(100 * F.least("na", "nb") >= s.percent * F.greatest("na", "nb"))

    def suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # |a - b| + |b - a| is at most (1 - t) / (1 + t) of both sizes together
            both = (batch.column(c).to_pylist() for c in ("na", "nb", "pa", "pb"))
            keep = [(100 + s.percent) * least_difference(p, q) <= (100 - s.percent) * (n + m) for n, m, p, q in zip(*both)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    likely = stored(near.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(suffix, "a long, b long"), "candidates")
    wanted = stored(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, "text")):
            found = pa.array([x.tobytes() for x in shingle_sets(texts_of(batch), s.words)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), found], names=["id", "set"])

    held = stored(with_ids(docs, "id", wanted, "left_semi").dropDuplicates(["id"]).mapInArrow(sets, "id long, set binary"), "wanted-sets")
    beside = (likely.join(held.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
              .join(held.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column("sa"), batch.column("sb")):  # views, not copies
                x, y = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(len(x) and 100 * common >= s.percent * (len(x) + len(y) - common)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return beside.select("a", "b", "sa", "sb").mapInArrow(task, "a long, b long")


def linked_groups(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    Words are runs of anything but ASCII white space, A-Z lower-cased.  Null or empty texts, and
    texts without words, have no shingle and link with nothing.  Equal sets link; a row without
    doc_id takes part in no link and has no component.  Rows of one doc_id should have one text;
    where they do not, any of them may make the id's links.  Other columns are ignored.
    """
    s = settings
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    known = rows.filter("id is not null")
    own = stored(signatures(rows, s), "signatures")
    classes = stored(own.filter("n_shingles > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
                     .filter("first < last").drop("last"), "classes")
    copies = stored(own.filter("n_shingles > 0").join(classes, "digest").filter("id <> first").select("id", "first"), "copies")
    one_each = with_ids(known, "id", copies.select("id"), "left_anti")
    table = stored(prefixes(one_each, count_table(known, s), s), "prefixes")
    members = table.select("id", "size", F.posexplode("keys").alias("pos", "key"))

    def near(x: str, y: str):
        """Length filter, and the shingles that can be shared from the first common one on: at a
        linked pair's first common shingle there must be enough, so other places may fail."""
        n, m = F.col(f"{x}size"), F.col(f"{y}size")
        possible = F.least(n - F.col(f"{x}pos"), m - F.col(f"{y}pos"))
        return ((100 * F.least(n, m) >= s.percent * F.greatest(n, m))
                & ((100 + s.percent) * possible >= s.percent * (n + m)))

    found = stored(groups(members, lambda pairs: linked(known, pairs, table.select("id", "size", "parity"), s), near), "groups")
    first = own.join(copies.distinct(), "id", "left").withColumn("rep", F.coalesce("first", "id"))
    return (first.join(found.withColumnRenamed("id", "rep"), "rep", "left")
            .select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component", "rep").alias("component_id")))


def one_of_each(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the documents that are linked to one of smaller doc_id, directly or through
    others.  Rows without doc_id stay; repeated rows of a document, equal in id and text, become one,
    that whose other columns sort first.  Column names do not matter."""
    with scratch():
        found = linked_groups(docs, settings)
        gone = stored(found.filter("doc_id <> component_id").select(F.col("doc_id").cast("long").alias("gone")).distinct(), "near-copies", outlives=1)
    left = docs.join(gone, F.col("doc_id").cast("long") == F.col("gone"), "left_anti")
    ids = left.filter("doc_id is not null").groupBy(F.col("doc_id").alias("again")).count().filter("count > 1").select("again")
    ids = stored(ids, "repeated-ids")
    same = F.col("doc_id") == F.col("again")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = (left.join(ids, same, "left_semi").groupBy(F.col("doc_id").alias("of"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("said"))
           .agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*"))
    return left.join(ids, same, "left_anti").unionByName(one)
