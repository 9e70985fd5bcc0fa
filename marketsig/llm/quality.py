"""Quality classifier: which of two zstandard dictionaries, built from good and from bad
labelled text, compresses a document better.

A text is cut into pieces of ``piece`` bytes (so that a dictionary helps along the whole text,
not only at its start) and each piece is compressed with either dictionary and with none.  The
difference of the compressed sizes, divided by the text's bytes and by the larger size, and the
plain ratio go through a logistic calibration fitted on labelled rows the dictionaries never saw.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketsig.llm.common import held_out, labelled_sample, texts_of

FRAME = 9  # bytes of frame header and footer in a compressed piece


@dataclass(frozen=True)
class Settings:
    """``max_rows`` bounds the labelled sample, ``sample_bytes`` the text a dictionary learns from."""

    dictionary: int = 64 << 10
    level: int = 3
    piece: int = 1024
    max_rows: int = 8192
    sample_bytes: int = 32 << 20
    penalty: float = 1.0
    threshold: float = 0.3


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the calibration; ``prior`` is returned where either class is missing."""

    good: bytes = b""
    bad: bytes = b""
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    prior: float = 0.0


class Sizes:
    """Compressed sizes of a text under both dictionaries and without one."""

    def __init__(self, good: bytes, bad: bytes, s: Settings):
        self.piece = s.piece
        self.coders = [zstandard.ZstdCompressor(level=s.level)]
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=s.level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, level=s.level))

    def features(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 3))
        for i, t in enumerate(texts):
            raw = t.encode()
            plain = good = bad = 0
            for at in range(0, len(raw), self.piece):
                part = raw[at: at + self.piece]
                p, g, b = (len(c.compress(part)) - FRAME for c in self.coders)
                plain, good, bad = plain + p, good + g, bad + b
            n = max(1, len(raw))
            out[i] = (bad - good) / n, (bad - good) / max(good, bad, 1), plain / n
        return out


def _quadratic(x: np.ndarray) -> np.ndarray:
    k = x.shape[1]
    pairs = [x[:, i] * x[:, j] for i in range(k) for j in range(i, k)]
    return np.stack([np.ones(len(x)), *x.T, *pairs], axis=1)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(v, -35, 35)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """Penalised logistic regression by Newton steps, halved until the loss falls."""
    w = np.zeros(x.shape[1])

    def loss(v):
        m = np.clip(x @ v, -35, 35)
        return float(np.sum(np.logaddexp(0, m) - y * m) + penalty / 2 * v @ v)

    for _ in range(50):
        p = _sigmoid(x @ w)
        gradient = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), gradient)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-4:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def _dictionary(texts: list[str], s: Settings) -> bytes:
    pieces, total = [], 0
    for t in texts:
        raw = t.encode()
        if total + len(raw) > s.sample_bytes:  # a text too long for the rest of the bound leaves room for others
            continue
        total += len(raw)
        pieces += [raw[at: at + 2 * s.piece] for at in range(0, len(raw), 2 * s.piece)]
    try:
        return zstandard.train_dictionary(min(s.dictionary, max(512, sum(map(len, pieces)) // 8)), pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves as one
        return b"".join(pieces)[: s.dictionary] or b"\0" * 8


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on at most ``max_rows`` labelled rows: of each class, every other row goes to its
    dictionary and the rest to the calibration.  One bounded task fits, the driver gets the model.
    """
    s = settings

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "doc_id", "text"], kind="stable")
        y = pdf.label.to_numpy().clip(0, 1)
        turn = np.where(y == 1, np.cumsum(y), np.cumsum(1 - y)) % 2
        texts = np.asarray(pdf.text, dtype=object)
        good, bad = texts[(y == 1) & (turn == 1)], texts[(y == 0) & (turn == 1)]
        if not len(good) or not len(bad):
            return pd.DataFrame({"good": [b""], "bad": [b""], "fitted": [[float(y.mean())]]})
        model = _dictionary(list(good), s), _dictionary(list(bad), s)
        held = turn == 0 if len(set(y[turn == 0])) == 2 else turn >= 0
        x, yc = Sizes(*model, s).features(list(texts[held])), y[held]
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        w = _logistic(_quadratic((x - mean) / scale), yc, s.penalty)
        return pd.DataFrame({"good": [model[0]], "bad": [model[1]], "fitted": [[float(y.mean()), *mean, *scale, *w]]})

    sample = labelled_sample(docs, labels, "quality", s.max_rows).withColumns({"order": F.xxhash64("doc_id"), "one": F.lit(1)})
    found = sample.groupBy("one").applyInPandas(build, "good binary, bad binary, fitted array<double>").collect()
    if not found:
        return Model()
    row, v = found[0], np.array(found[0].fitted)
    if len(v) == 1:
        return Model(prior=float(v[0]))
    return Model(bytes(row.good), bytes(row.bad), v[1:4], v[4:7], v[7:], float(v[0]))


def score_texts(texts: list[str], model: Model, sizes: Sizes | None) -> np.ndarray:
    if sizes is None:
        return np.full(len(texts), model.prior)
    # a text far outside what was seen is scored at the edge of it
    x = np.clip((sizes.features(texts) - model.mean) / model.scale, -6, 6)
    return _sigmoid(_quadratic(x) @ model.weights)


def score(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """All columns of ``docs`` plus ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold).

    Null texts score as empty ones.  Without a labelled row of either class every score is the
    share of good rows among the labelled (0 if there are none).  Columns named ``score`` or
    ``predicted`` in the input are replaced.
    """
    s = settings
    kept = docs.drop("score", "predicted")
    columns = kept.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", score double, predicted int"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sizes = Sizes(m.good, m.bad, s) if m.weights is not None else None
        for batch in batches:
            p = score_texts(texts_of(batch), m, sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [pa.array(p, pa.float64()), pa.array((p >= s.threshold).astype(np.int32))],
                names=[*columns, "score", "predicted"])

    return kept.mapInArrow(task, schema)


def op9(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    model = fit(docs, labels, settings)
    scored = score(docs.select("doc_id", "text"), model, settings)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
