"""Toxicity by a classifier chain of sparse linear models.

Categories are predicted in a fixed order; each model after the first also
reads the probabilities of the earlier ones, which in training are predicted
out of fold.  Features: hashed words of the whole text, present or not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize
from .vectext import by_row, column, pieces, words

#: Hashed word space; at most about so many labelled rows fit the chain; folds.
BITS, MAX_TRAIN, FOLDS = 18, 6000, 3
DIM = 1 << BITS


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word buckets of each row, end to end, and their row offsets."""
    hashes, first, _ = words(raw, off, bare=True)
    row = np.repeat(np.arange(len(off) - 1, dtype=np.uint64), np.diff(first))
    key = np.unique(row << np.uint64(BITS) | hashes >> np.uint64(64 - BITS))
    return (key & np.uint64(DIM - 1)).astype(np.int64), np.searchsorted(key >> np.uint64(BITS), np.arange(len(off)).astype(np.uint64))


@dataclass
class Linear:
    """Weights of the buckets, of earlier categories' log-odds, and the bias."""

    weights: np.ndarray
    chain: np.ndarray
    bias: float

    def score(self, buckets: np.ndarray, at: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        # Each row is summed for itself, so that equal texts score equally whatever stands beside them.
        return by_row(self.weights[buckets], at, np.add, 0) + earlier @ self.chain + self.bias


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def log_odds(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_linear(rows: list[np.ndarray], earlier: np.ndarray, y: np.ndarray, *, epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 3.0, l2: float = 0.5) -> Linear:
    """Logistic loss with elastic net, by follow-the-regularised-leader."""
    k = earlier.shape[1]
    z, n = np.zeros(DIM + k + 1), np.zeros(DIM + k + 1)
    free = np.zeros(DIM + k + 1, bool)
    free[DIM:] = True  # no L1 on the chain and the bias

    def solve(i):
        zi, pen = z[i], np.where(free[i], 0.0, l1)
        return np.where(np.abs(zi) <= pen, 0.0, -(zi - np.sign(zi) * pen) / ((beta + np.sqrt(n[i])) / alpha + l2))

    tail = np.arange(DIM, DIM + k + 1)
    for epoch in range(epochs):
        for r in np.random.default_rng(epoch).permutation(len(rows)):
            i = np.concatenate((rows[r], tail))
            x = np.ones(len(i))
            x[len(rows[r]) : -1] = earlier[r]
            w = solve(i)
            g = (sigmoid(x @ w) - y[r]) * x
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - step * w
            n[i] += g * g
    w = solve(np.arange(DIM + k + 1))
    return Linear(w[:DIM], w[DIM:-1], float(w[-1]))


@dataclass
class ToxicityChain:
    categories: list[str]
    models: list[Linear] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def probabilities(self, buckets: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows x categories; each is fed to the later models."""
        out = np.zeros((len(at) - 1, len(self.categories)))
        for c, m in enumerate(self.models):
            out[:, c] = sigmoid(m.score(buckets, at, log_odds(out[:, :c])))
        return out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of best F1 on out-of-fold probabilities, midway between two of them."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    if not len(y) or not hit[-1]:
        return 0.5
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + hit[-1])
    k = int(f1.argmax())
    after = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + after) / 2)


def train(docs: DataFrame, text_col: str, categories: dict[str, Column], key: Column, *, max_train: int = MAX_TRAIN) -> ToxicityChain | None:
    """Fits the chain on rows with a text and non-null 0/1 labels in all
    ``categories``, in order.  About ``max_train`` rows, chosen by the hash of
    ``key``, are used.  None if there is no labelled row."""
    names = list(categories)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.pmod(F.xxhash64(key), F.lit(1 << 40)).alias("h"), *(categories[c].cast("int").alias(f"y{i}") for i, c in enumerate(names)))
    rows = rows.where(" AND ".join(["text IS NOT NULL", *(f"y{i} IS NOT NULL" for i in range(len(names)))]))
    total = rows.select("h").count()
    if not total:
        return None
    some = rows.where(F.col("h") < int(min(1.0, max_train / total) * (1 << 40)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = column(b.column(0))
            for i, j in pieces(off):
                buckets, at = features(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                data = [buckets[x:y].astype(np.int32).tobytes() for x, y in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i), pa.array(data, pa.binary()), *(b.column(2 + c).slice(i, j - i) for c in range(len(names)))], names=["h", "x", *(f"y{c}" for c in range(len(names)))])

    made = materialize(some.mapInArrow(run, "h long, x binary, " + ", ".join(f"y{c} int" for c in range(len(names)))), "words")
    sample = sorted(made.collect())  # about max_train rows
    discard(made)
    if not sample:
        return None
    x = [np.frombuffer(r[1], np.int32).astype(np.int64) for r in sample]
    y = np.array([r[2:] for r in sample], float)
    fold = np.arange(len(x)) % FOLDS
    out_of_fold = np.zeros_like(y)
    chain = ToxicityChain(names)
    flat, at = np.concatenate(x), np.concatenate(([0], np.cumsum([len(i) for i in x])))
    for c in range(len(names)):
        earlier = log_odds(out_of_fold[:, :c])
        for f in range(FOLDS):
            train_on = np.flatnonzero(fold != f)
            if not len(train_on):
                train_on = np.arange(len(x))
            m = fit_linear([x[i] for i in train_on], earlier[train_on], y[train_on, c])
            held = fold == f
            out_of_fold[held, c] = sigmoid(m.score(flat, at, earlier))[held]
        chain.models.append(fit_linear(x, earlier, y[:, c]))
        chain.thresholds.append(best_threshold(out_of_fold[:, c], y[:, c]))
    return chain


def predict(docs: DataFrame, chain: ToxicityChain | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, and for each category ``p_<name>``
    and ``is_<name>``.  Without a chain (no labelled row) only ``id_col`` is
    returned.  A null text counts as empty; a very long one counts with all its
    words; equal texts have equal probabilities, repeated rows among them; a
    probability at the threshold counts as toxic.  An empty table gives no rows;
    other columns are ignored."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if chain is None:
        return src.select(F.col("id").alias(id_col))
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # a fixed size: DIM weights a category
    names = chain.categories

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for b in batches:
            raw, off = column(b.column(1))
            for i, j in pieces(off):
                p = chain.probabilities(*features(raw[off[i] : off[j]], off[i : j + 1] - off[i]))
                cols = [a for c in range(len(names)) for a in (pa.array(p[:, c]), pa.array(p[:, c] >= chain.thresholds[c]))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *cols], names=["id", *(f"{k}_{c}" for c in names for k in ("p", "is"))])

    return src.mapInArrow(run, "id long, " + ", ".join(f"p_{c} double, is_{c} boolean" for c in names)).withColumnRenamed("id", id_col)
