"""Concatenate and cut: one token stream over all documents, cut into windows of fixed length.

Pass one tokenizes and stores each task's rows with their place in the task's own stream.  The
tasks' token totals are summed up in two steps (blocks of tasks, then tasks in a block), which gives
every row its global offset.  Pass two cuts each row at the window borders that fall into it; a
piece that begins inside its document is a boundary record.  No row moves between the passes.

Only what is left after the last full window could need padding.  It is cut into sequences of
descending powers of two, so no sequence has any.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketsig.llm.common import parts, slices, stored, texts_of


@dataclass(frozen=True)
class Settings:
    """``tokenizer``: a file of the tokenizers library whose words never span white space.  ``memo``:
    pieces of text whose ids a task remembers.  ``block``: tasks whose totals are summed together.
    ``broadcast_tasks``: up to so many tasks (16 bytes each) their offsets are broadcast, beyond it
    Spark chooses the join."""

    tokenizer: str = public_tokenizers.path("word_bpe_49k.json")
    end_id: int = 2
    capacity: int = 4096
    memo: int = 1 << 19
    block: int = 1024
    broadcast_tasks: int = 1 << 20


#: Characters whose words are known without the tokenizer's own rules: no case, composition, contraction
#: or added token.  The groups are the tokenizer's: letters, single digits, runs of signs.
PLAIN = re.compile(r"(?:[a-zß-öø-ÿ0-9!-&(-/:;=-@\[-`{}~])+")
WORDS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class Encoder:
    """The ids, as little-endian bytes, of texts; remembers those of up to ``memo`` pieces between blanks.

    The tokenizer drops white space and never merges across it, so the ids of a text are those of its
    pieces between blanks, tabs and line ends, in order.  Unknown pieces are learned together: plain
    ones by the file's vocabulary as byte ranks, a blank standing for the end of a word (equal ids,
    tested), others by the tokenizer itself.
    """

    def __init__(self, path: str, memo: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer, self.memo, self.known = Tokenizer.from_file(path), memo, {}
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(c): c for c in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        whole = {t: bytes(byte_of[c] for c in t.removesuffix("</w>")) + b" " * t.endswith("</w>") for t in vocab if t not in added}
        order = np.full(self.tokenizer.get_vocab_size(), False)
        order[[vocab[t] for t, raw in whole.items() if raw.endswith(b" ") and len(raw) > 1]] = True
        self.ends = order
        self.ranks = tiktoken.Encoding(path, pat_str="[^ ]+ ", mergeable_ranks={raw: vocab[t] for t, raw in whole.items()}, special_tokens={})

    def learn(self, pieces: set[str]) -> None:
        single = [p for p in pieces if p.isalpha() and p.isascii() and p.islower()]
        pieces.difference_update(single)
        mixed = list(filter(PLAIN.fullmatch, pieces))
        pieces.difference_update(mixed)
        words = list(map(WORDS.findall, mixed))
        said = [*single, *(w for ws in words for w in ws), ""]
        ids = self.ranks.encode_to_numpy(" ".join(said), disallowed_special=())
        last = np.concatenate([np.arange(len(single)), len(single) + np.cumsum([len(w) for w in words], dtype=np.int64) - 1])
        cuts = ((np.flatnonzero(self.ends[ids]) + 1)[last] * np.dtype(self.dtype).itemsize).tolist()
        raw = ids.astype(self.dtype).tobytes()
        self.known.update(zip([*single, *mixed], [raw[i:j] for i, j in zip([0, *cuts], cuts)]))
        for piece in pieces:
            self.known[piece] = np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, self.dtype).tobytes()

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        for begin, end in slices(texts):
            cut = [(t if "<|" in t else t.encode().lower().decode()).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
                   for t in texts[begin:end]]
            said = set().union(*cut)
            new = said.difference(self.known)
            if len(new) + len(self.known) > self.memo:
                self.known.clear()
                new = said
            self.learn(set(new))
            for pieces in cut:
                yield b"".join(map(self.known.__getitem__, pieces))


@lru_cache(maxsize=2)
def encoder(path: str, memo: int) -> Encoder:
    return Encoder(path, memo)


def token_rows(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(task, before, length, doc_id, ids): every row's ids and how many its task has before them."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number, before = encoder(s.tokenizer, s.memo), TaskContext.get().partitionId(), 0
        end = np.array([s.end_id], encode.dtype).tobytes()
        for batch in batches:
            ids = [x + end for x in encode(texts_of(batch))]
            lengths = np.array([len(x) for x in ids], np.int64) // len(end)
            ends = before + np.cumsum(lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), number, np.int32)), pa.array(ends - lengths), pa.array(lengths), batch.column("doc_id"), pa.array(ids, pa.binary())],
                names=["task", "before", "length", "doc_id", "ids"])
            before = int(ends[-1]) if len(ends) else before

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, "task int, before long, length long, doc_id long, ids binary")


def task_offsets(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(task, base, total): the tokens of all tasks before each one, by prefix sums over blocks of tasks."""
    totals = rows.groupBy("task").agg(F.max(F.col("before") + F.col("length")).alias("total")).withColumn("block", F.floor(F.col("task") / s.block))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    blocks = totals.groupBy("block").agg(F.sum("total").alias("tokens"))
    blocks = blocks.select("block", F.coalesce(F.sum("tokens").over(earlier.orderBy("block")), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum("total").over(earlier.partitionBy("block").orderBy("task")), F.lit(0))
    return totals.withColumn("inside", inside).join(blocks, "block").select("task", (F.col("start") + F.col("inside")).alias("base"), "total")


def tail(total: int, capacity: int) -> list[int]:
    """Where the sequences after the last full window begin, and the end of the stream."""
    starts, left = [total - total % capacity], total % capacity
    while left:
        starts.append(starts[-1] + (1 << left.bit_length() - 1))
        left -= starts[-1] - starts[-2]
    return starts


def pack(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of ``docs`` (doc_id, text).

    A row's ids are its text's followed by ``end_id`` (null and empty texts: that id alone); every id
    is in one piece.  Repeated rows and null doc_ids are packed like any other row.  An empty table
    gives none; other columns are ignored.
    """
    s = settings
    rows = stored(token_rows(docs, s), "tokens")
    offsets = stored(task_offsets(rows, s), "task-offsets")
    n, total = offsets.agg(F.count("*"), F.max(F.col("base") + F.col("total"))).first()
    starts = tail(total or 0, s.capacity)
    placed = rows.join(F.broadcast(offsets) if n <= s.broadcast_tasks else offsets, "task")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(s.tokenizer, s.memo).dtype
        for batch in (part for whole in batches for part in parts(whole, "ids")):
            out: list[tuple] = []
            lengths = batch.column("length").to_numpy()
            raw = memoryview(np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype).astype("<u4")).cast("B")
            begins = (np.cumsum(lengths) - lengths).tolist()
            for doc, begin, length, first in zip(batch.column("doc_id").to_pylist(), batch.column("at").to_pylist(), lengths.tolist(), begins):
                done = 0
                while done < length:
                    at = begin + done
                    if at < starts[0]:
                        sequence, offset = divmod(at, s.capacity)
                        end = at - offset + s.capacity
                    else:
                        k = bisect_right(starts, at) - 1
                        sequence, offset, end = starts[0] // s.capacity + k, at - starts[k], starts[k + 1]
                    size = min(end - at, length - done)
                    out.append((doc, done, size, zlib.crc32(raw[4 * (first + done): 4 * (first + done + size)]), length, sequence, offset))
                    done += size
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * len(NAMES))], names=NAMES)

    return placed.select("doc_id", (F.col("base") + F.col("before")).alias("at"), "length", "ids").mapInArrow(task, ", ".join(f"{c} long" for c in NAMES))


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def boundaries(pieces: DataFrame) -> DataFrame:
    """(sequence_id, doc_id, start) of the sequences that begin inside a document."""
    return pieces.filter("start > 0").select("sequence_id", "doc_id", "start")
