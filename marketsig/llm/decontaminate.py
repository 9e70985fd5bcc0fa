"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Test items are put in size classes (shingle counts between two powers of two).  For each class a
document is cut into overlapping windows half as long again as the class's largest item, half an
item's length apart, so whichever run of an item's length a document holds lies whole inside one
window and the Jaccard similarity of item and window stays high however long the document is.  One
MinHash value shared by an item and a window of its class makes a candidate; the candidate is
verified by the exact share of the item's distinct shingles that occur in the whole document.

The window minima of all classes come from one pass: minima over the smallest step are merged
pairwise into those of the next class.  Items are a stated query set: they are searched in
blocks of bounded size, each block's index going to every task that scans the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketsig.llm.common import LETTERS, flat_ngrams, mix, ngrams, slices, stored, texts_of, word_hashes

LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Settings:
    """``words`` per shingle, least containment, MinHash functions, items searched at once."""

    words: int = 5
    containment: float = 0.8
    hashes: int = 24
    least_step: int = 8
    block: int = 20_000


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes([t.lower().encode() for t in texts], LETTERS)


def seeds(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


class Index:
    """A block of items: MinHash keys by size class, and each item's distinct shingles."""

    def __init__(self, ids: list[int], texts: list[str], s: Settings):
        self.s, self.ids, self.sets, self.short = s, ids, [], {}
        self.seeds = seeds(s.hashes)
        keys: dict[int, list[tuple]] = {}
        for i, text in enumerate(texts):
            words = words_of([text])[0]
            n = min(s.words, len(words))
            self.sets.append(np.unique(ngrams(words, n)) if n else words)
            if not n:
                continue
            if n < s.words:  # fewer words than a shingle: the whole item is one
                self.short.setdefault(n, []).append(i)
                continue
            step = s.least_step
            while step < len(words) - s.words + 1:
                step *= 2
            low = [(self.sets[-1] * a).min() + np.uint64(k) for k, a in enumerate(self.seeds)]
            keys.setdefault(step, []).extend((v, i) for v in low)
        self.steps = {}
        for step, pairs in keys.items():
            v, i = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.int64)
            order = np.argsort(v, kind="stable")
            likely = np.zeros(1 << 20, bool)  # by the low bits: minima have few high ones
            likely[v & np.uint64((1 << 20) - 1)] = True
            self.steps[step] = v[order], i[order], likely

    def candidates(self, h: np.ndarray) -> list[tuple[int, int, int]]:
        """(begin, end, item): runs of ``h`` that share a MinHash value with an item of their size."""
        found: set[tuple[int, int, int]] = set()
        if not self.steps or not len(h):
            return []
        top, cell0 = max(self.steps), self.s.least_step // 2
        v = np.full(-(-len(h) // top) * top + top, LAST, np.uint64)
        for k, a in enumerate(self.seeds):
            np.multiply(h, a, out=v[: len(h)])
            low, cell = v, 1
            while cell < top // 2:  # minima over cells twice as long each time
                low, cell = np.minimum(low[0::2], low[1::2]), cell * 2
                if cell < cell0 or 2 * cell not in self.steps:
                    continue
                keys, items, likely = self.steps[2 * cell]
                window = np.minimum(np.minimum(low[:-2], low[1:-1]), low[2:]) + np.uint64(k)
                for w in np.flatnonzero(likely[window & np.uint64((1 << 20) - 1)]):
                    lo, hi = np.searchsorted(keys, window[w], "left"), np.searchsorted(keys, window[w], "right")
                    found.update((int(w) * cell, (int(w) + 3) * cell, int(i)) for i in items[lo:hi])
        return list(found)

    def search(self, texts: list[str]) -> list[tuple[int, int, float]]:
        """(text number, item id, containment) of every item that a text holds."""
        s, best = self.s, {}
        words, bounds = words_of(texts)
        h, starts = flat_ngrams(words, bounds, s.words)
        pairs = set()
        for begin, end, i in self.candidates(h):  # a window may span texts: each is tried
            first, last = np.searchsorted(starts, begin, "right") - 1, np.searchsorted(starts, end, "left")
            pairs.update((d, i) for d in range(first, min(last, len(texts))))
        mine, of = None, -1
        for d, i in sorted(pairs):
            if d != of:
                mine, of = np.unique(h[starts[d]: starts[d + 1]]), d
            share = float(np.isin(self.sets[i], mine, assume_unique=True).mean())
            if share >= s.containment:
                best[d, self.ids[i]] = max(share, best.get((d, self.ids[i]), 0.0))
        for n, items in self.short.items():
            runs, begins = flat_ngrams(words, bounds, n)
            order = np.argsort(runs, kind="stable")
            for i in items:
                lo, hi = (np.searchsorted(runs, self.sets[i][0], side, sorter=order) for side in ("left", "right"))
                for at in order[lo:hi]:
                    best[int(np.searchsorted(begins, at, "right")) - 1, self.ids[i]] = 1.0
        return [(int(d), i, c) for (d, i), c in sorted(best.items())]


def matches(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, containment) of every document row and item at or over the least share.

    Words are runs of letters, digits and underscores (any character beyond ASCII counts as a
    letter), lower-cased.  An item of fewer than
    ``words`` words is one shingle of its own length; an item or document without words (null,
    empty) matches nothing, nor does an item without an id.  Items that share an id are searched
    apart and a pair keeps the larger share; repeated document rows give repeated results.
    Other columns are ignored, whatever their names.
    """
    s = settings
    spark = docs.sparkSession
    wanted = items.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).filter("item_id is not null")
    n = wanted.count()
    numbered = wanted.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(-(-max(n, 1) // s.block))))
    if n > s.block:
        numbered = stored(numbered, "items")
    todo = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, item_id long, containment double"
    out = None
    for b in range(-(-max(n, 1) // s.block)):
        rows = numbered.filter(F.col("block") == b).select("item_id", "text").orderBy("item_id", "text").collect()  # about `block` rows
        shared = spark.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows]))

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(*shared.value, s)
            for batch in batches:
                ids, texts = batch.column("doc_id").to_pylist(), texts_of(batch)
                hits = [(ids[begin + d], i, c) for begin, end in slices(texts) for d, i, c in index.search(texts[begin:end])]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in hits], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))],
                                                 names=["doc_id", "item_id", "containment"])

        part = todo.mapInArrow(task, schema)
        out = part if out is None else out.unionAll(part)
    return out


def clean(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the documents that hold an item; rows without an id stay."""
    found = stored(matches(docs, items, settings).select("doc_id").distinct(), "contaminated")
    return docs.join(found, "doc_id", "left_anti")
