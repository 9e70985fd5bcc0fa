"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each coordinate has its own learning rate (from its sum of squared gradients) and an L1
penalty, so the fitted model is a short list of (coordinate, weight) that any task can hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketsig.llm.common import (LETTERS, held_out, labelled_sample, mix, slices, texts_of,
                                  word_hashes)


@dataclass(frozen=True)
class Settings:
    """Model size and learning parameters; ``max_rows`` bounds the labelled sample."""

    bits: int = 22
    ngram: int = 2
    skip: int = 2
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.0
    positive_weight: float = 3.0  # of a toxic row's gradient: toxic rows are the rarer class
    epochs: int = 2
    shards: int = 1
    max_rows: int = 8192


@dataclass(frozen=True)
class Model:
    """Non-zero weights only.  ``fitted`` is false when no labelled row was found."""

    coordinates: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = 0.0
    fitted: bool = False


def features(texts: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(text number, coordinate) of every word n-gram and skip-gram, repeats included."""
    h, bounds = word_hashes([t.lower().encode() for t in texts], LETTERS)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    docs, coords = [doc], [mix(h)]
    run = mix(h)
    for n in range(2, s.ngram + 1):  # neighbouring words
        run = mix(run[:-1]) + h[n - 1:]
        inside = doc[: len(run)] == doc[n - 1:]
        docs.append(doc[: len(run)][inside])
        coords.append(mix(run + np.uint64(n))[inside])
    for gap in range(2, s.skip + 1):  # word pairs with gap - 1 words between them
        if len(h) > gap:
            pair = mix(h[:-gap]) + h[gap:] + np.uint64(1000 + gap)
            inside = doc[:-gap] == doc[gap:]
            docs.append(doc[:-gap][inside])
            coords.append(mix(pair)[inside])
    return np.concatenate(docs), (np.concatenate(coords) >> np.uint64(64 - s.bits)).astype(np.int32)


def _ftrl(texts: list[str], labels: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights after ``epochs`` passes in the given order; features are present or absent."""
    z, n = np.zeros(1 << s.bits, np.float64), np.zeros(1 << s.bits, np.float64)
    zb = nb = 0.0

    def weights(zi, ni):
        return np.where(np.abs(zi) <= s.l1, 0.0,
                        -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(ni)) / s.alpha + s.l2))

    def bias():
        return -zb / ((s.beta + nb ** 0.5) / s.alpha)

    rows = [np.unique(features([t], s)[1]) for t in texts]
    for _ in range(s.epochs):
        for x, y in zip(rows, labels):
            w = weights(z[x], n[x])
            b = bias()
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
            g *= s.positive_weight if y else 1.0
            grown = n[x] + g * g
            z[x] += g - (np.sqrt(grown) - np.sqrt(n[x])) / s.alpha * w
            n[x] = grown
            zb += g - ((nb + g * g) ** 0.5 - nb ** 0.5) / s.alpha * b
            nb += g * g
    w = weights(z, n)
    keep = np.flatnonzero(w)
    return keep.astype(np.int32), w[keep].astype(np.float32), bias()


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on at most ``max_rows`` labelled rows: one FTRL run per shard, weights averaged.

    A shard holds ``max_rows / shards`` rows, so both its task and the collected model are
    bounded by the settings.  No labelled row: an unfitted model.
    """
    s = settings
    sample = labelled_sample(docs, labels, "toxic", s.max_rows).withColumns(
        {"order": F.xxhash64("doc_id"), "shard": F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(s.shards))})

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "doc_id", "text"], kind="stable")
        c, w, b = _ftrl(list(pdf.text), pdf.label.to_numpy(), s)
        return pd.DataFrame({"c": [c.tobytes()], "w": [w.tobytes()], "b": [b]})

    parts = sample.groupBy("shard").applyInPandas(shard, "c binary, w binary, b double").collect()
    if not parts:
        return Model()
    c = np.concatenate([np.frombuffer(bytes(p.c), np.int32) for p in parts])
    w = np.concatenate([np.frombuffer(bytes(p.w), np.float32) for p in parts])
    uniq, at = np.unique(c, return_inverse=True)
    mean = np.bincount(at, weights=w, minlength=len(uniq)) / len(parts)
    return Model(uniq, mean.astype(np.float32), float(np.mean([p.b for p in parts])), True)


def score_texts(texts: list[str], model: Model, dense: np.ndarray, s: Settings) -> np.ndarray:
    out = np.full(len(texts), model.bias)
    for begin, end in slices(texts):
        doc, c = features(texts[begin:end], s)
        hit = np.flatnonzero(dense[c])  # the few that carry weight; each counts once a text
        key = np.unique(doc[hit].astype(np.int64) << 32 | c[hit])
        out[begin:end] += np.bincount(key >> 32, weights=dense[key & 0xFFFFFFFF], minlength=end - begin)
    return 1.0 / (1.0 + np.exp(-np.clip(out, -35, 35)))


def score(docs: DataFrame, model: Model, settings: Settings = Settings(), names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of ``docs`` plus ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5), or other ``names``.

    Null and empty texts have no features and score the bias alone; an unfitted model gives 0.
    Columns of these names in the input are replaced.
    """
    s = settings
    kept = docs.drop(*names)
    columns = kept.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)  # non-zero weights, at most 2**bits
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + f", `{names[0]}` double, `{names[1]}` int"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        dense = np.zeros(1 << s.bits, np.float32)
        dense[m.coordinates] = m.weights
        for batch in batches:
            texts = texts_of(batch)
            p = score_texts(texts, m, dense, s) if m.fitted else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))],
                names=[*columns, *names])

    return kept.mapInArrow(task, schema)


def op1(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``, scored by a model learned from the labels
    that are not held out; null ids and repeated rows are scored like any other."""
    model = fit(docs, labels, settings)
    scored = score(docs.select("doc_id", "text"), model, settings)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
