"""Language identification by a string kernel.

The blended-spectrum presence kernel of two texts counts the byte n-grams (of all ORDERS, lower
case) that both hold, divided by the root of the product of both counts. Landmark texts give
its Nyström features, K(x, landmarks) K(landmarks, landmarks)^-1/2; on these, one kernel ridge
regression per language, one versus the rest, is solved in closed form. A batch is scored by
matrix products: presence rows times landmarks, then times the regression weights.
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

ORDERS, BITS = (1, 2, 3, 4), 16
#: Bounds of the rows that are learnt from and of the landmarks among them.
MAX_TRAIN, LANDMARKS, RIDGE = 3000, 128, 1e-2


@dataclass
class Model:
    """product: features x languages, landmarks times K^-1/2 times the ridge weights, which
    batches are multiplied with in one go (the order of products doesn't change the result)."""

    languages: list[str]
    product: np.ndarray
    bias: np.ndarray

    def predict(self, ptr: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and its share among the languages' outputs."""
        norm = np.sqrt(np.maximum(np.diff(ptr), 1))[:, None]
        out = row_sums(self.product, ptr, features) / norm + self.bias
        share = np.exp(6 * (out - out.max(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        return best, share[np.arange(len(best)), best]


def _dense(rows: list[np.ndarray]) -> np.ndarray:
    """Presence rows of unit length."""
    out = np.zeros((len(rows), 1 << BITS), dtype=np.float32)
    for i, r in enumerate(rows):
        out[i, r] = 1 / np.sqrt(max(len(r), 1))
    return out


def fit(texts: list[str | None], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """A model of the languages seen; landmarks are dealt evenly to the languages."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0))
    rows = sample_features(texts, ORDERS, BITS, tn.lowered_latin)
    index = np.array([names.index(x) for x in langs])
    each = max(1, landmarks // len(names))
    chosen = np.concatenate([np.flatnonzero(index == k)[:each] for k in range(len(names))])
    marks = _dense([rows[i] for i in chosen])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    kernel = np.concatenate([_dense(rows[at : at + 256]) @ marks.T for at in range(0, len(rows), 256)])
    phi = np.concatenate([kernel @ root, np.ones((len(rows), 1))], axis=1)
    count = np.bincount(index, minlength=len(names))
    weight = (len(rows) / len(names) / count[index])[:, None]  # languages weigh the same
    target = np.where(index[:, None] == np.arange(len(names)), 1.0, -1.0)
    solved = np.linalg.solve((phi * weight).T @ phi + ridge * np.eye(phi.shape[1]), (phi * weight).T @ target)
    return Model(names, (marks.T.astype(np.float64) @ (root @ solved[:-1])), solved[-1])


def identify(docs: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text, lang, ...).

    Learns from text and non-null lang of rows whose fold of 4 isn't 2, at most ``max_train`` of
    them, an even share of each language. A text that is null or has no letter is ``und`` with score 1; so is every text where
    there is nothing to learn from (score 0). Rows without doc_id are predicted, not learnt
    from, and not held out. Ties go to the first language by name. Other columns are ignored.
    """
    seen = docs.where((fold(F.col("doc_id"), 4) != 2) & F.col("text").isNotNull()).select("doc_id", "lang")
    rows = sample(docs.select("doc_id", "text"), seen, "lang", max_train, each=True)
    model = fit(rows["text"].tolist(), rows["lang"].tolist())
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    def run(batches):
        for batch in batches:
            best, share = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            if model.languages:
                for first, buf, off in tn.slices(batch.column(1)):
                    low = tn.lowered_latin(buf)
                    for at, ptr, features in presence(low, off, ORDERS, BITS):
                        own = slice(first + at, first + at + len(ptr) - 1)
                        best[own], share[own] = model.predict(ptr, features)
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            names = np.array([*model.languages, "und"], dtype=object)
            index = np.where(letters & bool(model.languages), best, len(model.languages))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[index], pa.string()), pa.array(np.where(letters, share, 1.0))], names=["doc_id", "lang_pred", "score"])

    out = docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
