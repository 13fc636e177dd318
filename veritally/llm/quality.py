"""Quality by naive-Bayes support vectors.

Indicators of byte n-grams, of words said again at once (copies of a word in a row) and of the
text's length class are scaled by their log-count ratio between the classes; a linear
hinge-loss model over the scaled indicators (rows of unit length) is fitted by dual coordinate
descent, drawn towards its mean weight, and its margins become probabilities by a logistic fit
on margins of rows outside the fit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritally.llm import textnum as tn
from veritally.llm.ngram_sets import fold, presence, row_sums, sample, sample_features

ORDERS, BITS = (1, 2, 3), 16
#: After the n-grams: runs of one word of these lengths or more, and the power of two of the words.
RUNS, CLASSES = (2, 3, 5, 9, 17), 24
FEATURES = (1 << BITS) + len(RUNS) + CLASSES + 1
#: The bound of the rows that the model is fitted on.
MAX_TRAIN = 3000


@dataclass
class Model:
    """weights of the features (ratio times hinge weight), squares of the ratios, and the logistic."""

    weights: np.ndarray
    squares: np.ndarray
    slope: float
    offset: float

    def scores(self, ptr: np.ndarray, features: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
        both = np.stack([self.weights, self.squares], axis=1)
        sums = row_sums(both, ptr, features) + (0 if more is None else both[more].sum(axis=1))
        margin = sums[:, 0] / np.sqrt(np.maximum(sums[:, 1], 1e-12))
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -35, 35)))


def shape(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """rows x (runs and length class): feature numbers; the last feature, without weight, for no."""
    s, e, ptr = tn.words(buf, off)
    word = tn.span_hashes(buf, s, e)
    again = np.zeros(len(word), dtype=bool)
    again[1:] = word[1:] == word[:-1]
    again[ptr[:-1][ptr[:-1] < ptr[1:]]] = False
    a, b, at = tn.spans(again, ptr)
    most = np.zeros(len(off) - 1, np.int64)
    np.maximum.at(most, np.repeat(np.arange(len(off) - 1), np.diff(at)), b - a + 1)
    out = np.full((len(off) - 1, len(RUNS) + 1), FEATURES - 1)
    for k, run in enumerate(RUNS):
        out[most >= run, k] = (1 << BITS) + k
    out[:, -1] = (1 << BITS) + len(RUNS) + np.minimum(np.ceil(np.log2(np.diff(ptr) + 1)), CLASSES - 1).astype(np.int64)
    return out


def _rows(texts: list[str | None]) -> list[np.ndarray]:
    """All features of a bounded list of texts."""
    extra = [x for _, buf, off in tn.slices(pa.array(texts, pa.string())) for x in shape(buf, off)]
    return [np.concatenate([r, x[x < FEATURES - 1].astype(r.dtype)]) for r, x in zip(sample_features(texts, ORDERS, BITS), extra, strict=True)]


def _ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The log-count ratio of each feature, counts of rows from 1."""
    counts = [1 + np.bincount(np.concatenate([r for r, own in zip(rows, y, strict=True) if own == k] or [np.zeros(0, np.int32)]), minlength=FEATURES) for k in (0, 1)]
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def _descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Hinge loss with an L2 penalty, by dual coordinate descent; classes weigh the same."""
    sign = np.where(y == 1, 1.0, -1.0)
    upper = c * len(y) / 2 / np.where(y == 1, max(1, (y == 1).sum()), max(1, (y == 0).sum()))
    scale = np.array([1 / max(np.sqrt((ratio[r] ** 2).sum()), 1e-6) for r in rows])
    square = np.array([((ratio[r] * k) ** 2).sum() for r, k in zip(rows, scale, strict=True)])
    w, alpha, rng = np.zeros(FEATURES), np.zeros(len(y)), np.random.default_rng(5)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(y)):
            if square[i] <= 0:
                continue
            value = ratio[rows[i]] * scale[i]
            gradient = sign[i] * (w[rows[i]] @ value) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), upper[i])
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * sign[i] * value
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return 0.75 * w + 0.25 * np.abs(w).mean() * np.sign(w)


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with Platt's smoothed targets and a floor on the slope."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    ab, x = np.array([1.0, 0.0]), np.stack([margin, np.ones(len(y))], axis=1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p))
        ab += step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return float(max(ab[0], 1e-3)), float(ab[1])


def fit(texts: list[str | None], y: np.ndarray) -> Model:
    """texts and their 0/1 labels, at most a bounded sample. One class or none: its share is the score."""
    zero = np.zeros(FEATURES)
    if len(set(y.tolist())) < 2:
        return Model(zero, zero, 1.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 0.0)
    rows = _rows(texts)

    def part(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = [rows[i] for i in chosen]
        ratio = _ratio(own, y[chosen])
        w, squares = ratio * _descend(own, y[chosen], ratio), ratio**2
        w[-1] = squares[-1] = 0
        return w, squares

    half, margins = np.arange(len(y)) % 2, np.zeros(len(y))
    for k in (0, 1):
        inside, outside = np.flatnonzero(half != k), np.flatnonzero(half == k)
        if len(set(y[inside].tolist())) == 2:
            w, sq = part(inside)
            margins[outside] = [w[rows[i]].sum() / max(np.sqrt(sq[rows[i]].sum()), 1e-6) for i in outside]
    weights, squares = part(np.arange(len(y)))
    return Model(weights, squares, *_logistic(margins, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs and ``score``, the probability of label 1; a null text counts as empty."""
    docs = docs.drop("score")
    at_text = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for first, buf, off in tn.slices(batch.column(at_text).cast(pa.string())):
                more = shape(buf, off)
                for at, ptr, features in presence(buf, off, ORDERS, BITS):
                    own = slice(at, at + len(ptr) - 1)
                    out[first:][own] = model.scores(ptr, features, more[own])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_train: int = MAX_TRAIN, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted (and columns named in keep) of every row of docs.

    Labels (doc_id, quality 0/1) are learnt only from rows whose fold of 5 isn't 0. Rows with a
    null text are scored as empty texts; rows without doc_id are scored and not held out; of
    labels that repeat a doc_id the greatest counts. With one class or no label every score is
    the smoothed share of label 1. Other columns of either table are ignored.
    """
    seen = labels.where(fold(F.col("doc_id"), 5) != 0)
    rows = sample(docs, seen, "quality", max_train)
    model = fit(rows["text"].tolist(), rows["quality"].to_numpy().astype(int))
    scored = score(docs.select(*dict.fromkeys(["doc_id", "text", *keep])), model)
    out = scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *[c for c in keep if c != "doc_id"])
    return out
