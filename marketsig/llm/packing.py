"""Best-fit packing by sums of squares: documents as token pieces in sequences of fixed capacity.

Only documents over the capacity are cut.  A piece goes where the sum of the squared numbers of
open sequences per residual gap becomes smallest, which keeps all gaps about equally available
and wastes little.  Pieces are dealt to shards of bounded size by a hash of their row, and a
shard is packed on its own; a shard's waste is a few sequences, so larger shards waste less.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketsig.llm.common import slices, stored, texts_of


@dataclass(frozen=True)
class Settings:
    """``tokenizer`` is a byte-level BPE file of the tokenizers library, ``shard`` the pieces packed together;
    ``added`` gives the file's added tokens in a text their own ids, else they are ordinary text."""

    tokenizer: str = public_tokenizers.path("byte_bpe_50k.json")
    pattern: str = public_tokenizers.PATTERN
    end_id: int = 2
    capacity: int = 1024
    shard: int = 100_000
    added: bool = False


#: What the query and the pipeline take: the ids of ``Tokenizer.encode(text, add_special_tokens=False)``.
CONTRACT = Settings(added=True)


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    """The file's vocabulary as byte ranks: the same ids as the tokenizers library, made faster.

    In a byte-level file printable Latin-1 characters stand for their own byte and the other
    bytes, in order, for the characters from 256 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    flags = [f for t in spec.get("added_tokens", ()) for f in ("single_word", "lstrip", "rstrip", "normalized") if t[f]]
    if flags:
        raise ValueError(f"{path}: added tokens with {', '.join(flags)}")
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


def token_pieces(docs: DataFrame, settings: Settings = Settings(), with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document row.

    A document's ids are its text's followed by ``end_id`` (null and empty texts: that id alone).
    Over the capacity it is cut: the first piece takes the remainder and the others are full.
    ``with_ids`` adds the ids as an array column.
    """
    s = settings
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(s.tokenizer, s.pattern)
        encode = partial(encoding.encode, allowed_special="all") if s.added else encoding.encode_ordinary
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), texts_of(batch)
            for begin, end in slices(texts):
                rows: list[tuple] = []
                for doc, text in zip(ids[begin:end], texts[begin:end]):
                    tokens = np.array([*encode(text), s.end_id], "<u4")
                    start, cut = 0, len(tokens) % s.capacity or s.capacity
                    piece = 0
                    while start < len(tokens):
                        part = tokens[start:cut]
                        rows.append((doc, piece, start, len(part), zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if with_ids else [])))
                        start, cut, piece = cut, cut + s.capacity, piece + 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(5 + with_ids)],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, schema)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, largest first, each placed for the least sum of squares.

    A new bin is opened only when no open one has room.
    """
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        old, new = count[size:capacity], count[: capacity - size]
        cost = 2 * (new - old) + 2
        if len(cost):
            cost[0] = 1 - 2 * old[0]  # a filled bin is no longer open
            cost = np.where(old > 0, cost, np.iinfo(np.int64).max)
            best = int(cost.argmin())
        if len(cost) and old[best]:
            gap = size + best
            at = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, at, used = capacity, used, used + 1
        bins[i], offsets[i] = at, capacity - gap
        if gap > size:
            open_bins[gap - size].append(at)
            count[gap - size] += 1
    return bins, offsets


def pack(pieces: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``pieces`` plus ``sequence_id`` and ``offset``; a column ``length`` of 1 to ``capacity`` is needed.

    Every row gets a place.  Offsets in a sequence begin at 0 and leave no gap.  No rows: no rows.
    """
    s = settings
    kept = stored(pieces.drop("sequence_id", "offset"), "pieces")
    shards = max(1, -(-kept.count() // s.shard))
    # by row number in the written table: repeated rows spread too, and a rerun task deals alike
    dealt = kept.withColumn("__shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", sequence_id long, offset long"

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["__shard"].iloc[0])
        order = [c for c in ("length", "doc_id", "piece") if c in pdf.columns]
        pdf = pdf.drop(columns="__shard").sort_values(order, kind="stable")
        bins, offsets = place(pdf["length"].to_numpy(), s.capacity)
        return pdf.assign(sequence_id=(number << 32) + bins, offset=offsets)

    return dealt.groupBy("__shard").applyInPandas(shard, schema)


def op8(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return pack(token_pieces(docs, settings), settings)
