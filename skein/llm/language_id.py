"""Language identification by sparse multinomial logistic regression.

Features: TF-IDF of hashed character 1- to 3-grams of the whole text.  Trained
by follow-the-regularised-leader with elastic-net penalties on a bounded
sample, then calibrated by a temperature on rows kept out of the fit.
Document frequencies cover all training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize
from .vectext import column, pieces

#: Hashed feature space; at most so many rows fit the classifier.
DIM, MAX_TRAIN = 1 << 13, 4000
UNKNOWN = "und"


def _grams(points: np.ndarray) -> np.ndarray:
    """Counts of the hashed 1-, 2- and 3-grams of a text's code points."""
    x = points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = np.zeros(DIM, np.int64)
    mul = np.uint64(0xD6E8FEB86659FD93)
    shift = np.uint64(64 - DIM.bit_length() + 1)
    h = x * mul
    for n in (1, 2, 3):
        if n > 1:
            h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * mul + x[n - 1 :]
        if len(h):
            out += np.bincount(((h * mul) >> shift).astype(np.int64), minlength=DIM)
    return out


def _texts(array: pa.Array) -> Iterator[tuple[int, str]]:
    raw, off = column(array)
    for i, j in pieces(off, 1 << 21):
        data = raw[off[i] : off[j]].tobytes()
        at = (off[i : j + 1] - off[i]).tolist()
        for k in range(j - i):
            yield i + k, data[at[k] : at[k + 1]].decode().lower()


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    """Labels, weights (features x labels), bias, idf and temperature."""

    labels: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def features(self, i: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """TF-IDF of the buckets ``i`` with their counts, of length 1."""
        x = (1 + np.log(tf)) * self.idf[i]
        return x / (np.sqrt((x * x).sum()) or 1.0)

    def logits(self, i: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return self.features(i, tf) @ self.weights[i] + self.bias

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        i = np.flatnonzero(counts)
        z = self.logits(i, counts[i]) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


#: A training row: buckets, their counts, the label's number.
Row = tuple[np.ndarray, np.ndarray, int]


def fit_ftrl(model: LanguageModel, rows: list[Row], *, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> None:
    """Per-coordinate FTRL-proximal on softmax loss; L1 and L2 keep weights sparse and small."""
    k = len(model.labels)
    z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))

    def solve(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for epoch in range(epochs):
        for at in np.random.default_rng(epoch).permutation(len(rows)):
            i, tf, y = rows[at]
            i, x = np.append(i, DIM).astype(np.int64), np.append(model.features(i, tf), 1.0)
            w = solve(i)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - step * w
            n[i] += g * g
    w = solve(np.arange(DIM + 1))
    model.weights, model.bias = w[:-1], w[-1]


def calibrate(model: LanguageModel, rows: list[Row]) -> float:
    """The temperature of least negative log-likelihood on ``rows``, by golden-section search on its logarithm."""
    if not rows:
        return 1.0
    z, y = np.array([model.logits(i, tf) for i, tf, _ in rows]), np.array([y for *_, y in rows])

    def loss(t: float) -> float:
        s = z / np.exp(t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    lo, hi, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, text_col: str, label_col: str, key: Column, *, max_train: int = MAX_TRAIN, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3) -> LanguageModel | None:
    """Fits on the rows of ``docs`` with a non-null label and a letter in their
    text.  Every such row counts in the document frequencies; about
    ``max_train`` of them, chosen by the hash of ``key``, fit the weights (four
    fifths) and the temperature (one fifth).  None if there is no such row."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"), F.pmod(F.xxhash64(key), F.lit(1 << 40)).alias("h")).where("text IS NOT NULL AND label IS NOT NULL")
    counts = rows.groupBy("label").agg(F.count("*").alias("n")).collect()
    if not counts:
        return None
    # Labels share the bound evenly; an unlabelled surplus of a rare label is not redistributed.
    share = {r["label"]: min(1.0, max_train / len(counts) / r["n"]) for r in counts}
    labels = sorted(share)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, seen = np.zeros(DIM, np.int64), 0
        picked: list[tuple[int, str, bytes]] = []
        names = ["kind", "at", "n", "label", "tf"]

        def emit(kind, rows):
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.binary())], names=names)

        for batch in batches:
            label, h = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for r, text in _texts(batch.column(0)):
                if not has_letter(text):
                    continue
                tf = _grams(_points(text))
                df += tf > 0
                seen += 1
                if h[r] < share[label[r]] * (1 << 40):
                    i = np.flatnonzero(tf)
                    picked.append((h[r], len(i), label[r], i.astype(np.uint16).tobytes() + tf[i].astype(np.uint32).tobytes()))
            if picked:
                yield emit(1, picked)
                picked = []
        full = np.flatnonzero(df).tolist()
        yield emit(0, [(-1, seen, None, None), *((i, int(df[i]), None, None) for i in full)])

    got = materialize(rows.mapInArrow(gather, "kind int, at long, n long, label string, tf binary"), "grams")
    sums = {r["at"]: r["n"] for r in got.where("kind = 0").groupBy("at").agg(F.sum("n").alias("n")).collect()}  # DIM + 1 rows at most
    total = sums.pop(-1, 0) or 0
    df = np.zeros(DIM)
    df[list(sums)] = list(sums.values())
    sample = sorted(got.where("kind = 1").select("at", "n", "label", "tf").collect())  # max_train rows or so
    discard(got)
    if not sample:
        return None
    model = LanguageModel(labels, np.zeros((DIM, len(labels))), np.zeros(len(labels)), np.log((1 + total) / (1 + df)) + 1)
    data = [(np.frombuffer(tf, np.uint16, n), np.frombuffer(tf, np.uint32, n, 2 * n), labels.index(label)) for _, n, label, tf in sample]
    fit_ftrl(model, [x for i, x in enumerate(data) if i % 5], alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=epochs)
    model.temperature = calibrate(model, data[::5])
    return model


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``lang_pred`` (a learned label, or
    ``und`` for a text that is null or has no letter, or without a model) and
    ``score`` (calibrated probability, 0 for ``und``).  Very long texts count
    whole, repeated rows each for itself; of labels with equal probabilities the
    first in order is taken.  An empty table gives no rows; other columns are
    ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            for r, text in _texts(batch.column(1)):
                if model is not None and has_letter(text):
                    p = model.probabilities(_grams(_points(text)))
                    label[r], score[r] = model.labels[int(p.argmax())], float(p.max())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label, pa.string()), pa.array(np.clip(score, 0, 1))], names=["id", "lang_pred", "score"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)
