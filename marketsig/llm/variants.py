"""Spelling variants: words one edit apart, found among sorted permuterm rotations.

A word is marked with a terminator and rotated.  Turned so that an edited character stands last, two
words that differ by replacing it share the rest of the rotation, and a word without that character
has this rest as one of its own rotations.  All rotations are sorted; a run of equal rests holds the
words with any last character and at most one word without it.  An alphabet bounds a run (91 rows
here), and scanning gives each of its rows the number of its neighbours there and the best one,
without writing out the pairs.

A character next to its equal may be deleted at either place with the same result; only the first
of such places links words of different length, so no neighbour counts twice.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketsig.llm.common import stored, texts_of


@dataclass(frozen=True)
class Settings:
    """Least code points and occurrences of a word, how many times as frequent its form is, one in
    ``damage`` (document, word) pairs losing a character, words a task counts before it passes them on."""

    least_chars: int = 7
    least_count: int = 2
    times: int = 10
    damage: int = 31
    held: int = 1 << 18


MARK = "$"  # no letter


def occurrences(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(word, n): partial counts of the words of ``docs`` (doc_id, text), several rows a word.

    A run's hash, over its document's id (null: nothing) and itself, decides whether it loses a character.
    """
    # a run that loses a character must still be long enough, shorter ones never are
    runs = re.compile(f"[a-zÀ-ÿ]{{{s.least_chars},}}")

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                said = text.encode().lower().decode()  # of bytes only A-Z are lower-cased
                found = Counter(runs.findall(said) if len(said) < 1 << 20 else (m[0] for m in runs.finditer(said)))
                for run, n in found.items():
                    h = zlib.crc32(run.encode(), start)
                    if h % s.damage == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                        if len(run) < s.least_chars:
                            continue
                    held[run] += n
                if len(held) >= s.held:
                    yield rows(held)
                    held.clear()
        yield rows(held)

    return docs.select("doc_id", "text").mapInArrow(task, "word string, n long")


def words(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(word, n) of every word that occurs often enough."""
    return occurrences(docs, s).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= s.least_count)


def rotations(vocabulary: DataFrame) -> DataFrame:
    """(key, skips, m, word, first): all rotations of each marked word, whole and without their last letter.

    ``m`` is the count's negative, so that sorting puts the most frequent word first; ``first`` tells
    that the letter left out does not follow its equal.
    """
    size = F.length("word")
    turned = vocabulary.select("word", (-F.col("n")).alias("m"), F.explode(F.sequence(F.lit(0), size)).alias("i"))
    head, rest = F.substring("word", F.lit(1), F.col("i")), F.expr("substring(word, i + 1)")
    whole = turned.select(F.concat(rest, F.lit(MARK), head).alias("key"), F.lit(0).alias("skips"), "m", "word", F.lit(False).alias("first"))
    less = turned.filter(F.col("i") < size).select(
        F.concat(F.expr("substring(word, i + 2)"), F.lit(MARK), head).alias("key"), F.lit(1).alias("skips"), "m", "word",
        ((F.col("i") == 0) | (F.expr("substring(word, i + 1, 1)") != F.expr("substring(word, i, 1)"))).alias("first"))
    return whole.unionByName(less)


def _scan(run: pa.Table) -> pa.RecordBatch:
    """(word, near, m, other) of the rows of whole groups of one key, sorted by key, skips, m and word."""
    n = run.num_rows
    key, word = run["key"].combine_chunks(), run["word"].combine_chunks()
    skips, m, first = (run[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("skips", "m", "first"))
    begins = np.concatenate([[0], 1 + np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False))]).astype(np.int64) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begins, n))
    whole = skips[begins] == 0  # the word that has the key as its whole rotation
    best = begins + whole  # the first of the rows that leave a letter out
    k = sizes - whole
    group = np.repeat(np.arange(len(begins)), sizes)
    rows = np.arange(n)
    # replacements: every other row that leaves a letter out
    a = rows[(skips == 1) & (k[group] >= 2)]
    a_best = np.where(a == best[group[a]], a + 1, best[group[a]])
    # the word without the letter, seen from those with it
    b = rows[(skips == 1) & first & whole[group]]
    # and those with it, seen from the word without
    at = begins[group[b]]
    first_of, index, count = np.unique(at, return_index=True, return_counts=True)
    own = np.concatenate([a, b, first_of])
    near = np.concatenate([k[group[a]] - 1, np.ones(len(b), np.int64), count])
    other = np.concatenate([a_best, at, b[index]])
    return pa.RecordBatch.from_arrays([word.take(pa.array(own)), pa.array(near.astype(np.int64)), pa.array(m[other].astype(np.int64)), word.take(pa.array(other))],
                                      names=["word", "near", "m", "other"])


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best) of every word of ``vocabulary`` (word, n) with a near one; best is (m, other): its near
    word of largest count, the first in code-point order of equal ones."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key")
            last = int(pc.index(keys, keys[-1]).as_py())  # the last group may go on in the next batch
            if last or held and held[-1].column("key")[-1] != keys[0]:
                yield _scan(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield _scan(pa.Table.from_batches(held))

    ordered = rotations(vocabulary).repartitionByRange("key").sortWithinPartitions("key", "skips", "m", "word")
    return (ordered.mapInArrow(task, "word string, near long, m long, other string")
            .groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("m", "other")).alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the last of word, form, form's form and so on.

    A form is several times as frequent as its word, so chains are short and never close; each
    round doubles how far a word has followed its own.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = longer.drop("moved")
        if longer.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs`` (doc_id, text).

    Words are the runs of A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z lower-cased, one in ``damage``
    without a character; those too short or too rare go.  Null and empty texts have none, a null
    doc_id hashes as an empty one, repeated rows count each time; other columns are ignored.
    """
    s = settings
    vocabulary = stored(words(docs, s), "words")
    near = vocabulary.join(neighbours(vocabulary), "word", "left")
    is_form = -F.col("best.m") >= s.times * F.col("n")
    found = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                               F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n")), "variants")
    last = roots(found.filter("form is not null"))
    return (found.join(last, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
