"""Presence of hashed byte n-grams: the sparse rows of the text classifiers.

Also what they share: the fold of a document, and a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritally.llm import textnum as tn

ROWS = 128


def presence(buf: np.ndarray, off: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, row pointer, features): each row's distinct hashed n-grams, for runs of rows.

    An n-gram is a run of n bytes within a row; all orders share 2**bits features.
    """
    shift = np.uint32(32 - bits)
    for at in range(0, len(off) - 1, ROWS):
        own_off = off[at : at + ROWS + 1] - off[at]
        own = buf[off[at] : off[min(at + ROWS, len(off) - 1)]].astype(np.uint32)
        rows = len(own_off) - 1
        flags = np.zeros(rows << bits, dtype=bool)
        base = np.repeat(np.arange(rows, dtype=np.int64) << bits, np.diff(own_off))
        h = own + np.uint32(1)
        with np.errstate(over="ignore"):
            for n in range(1, max(orders) + 1):
                if n > 1:
                    h = h[:-1] * np.uint32(0x01000193) + own[n - 1 :]
                if n in orders and len(h):
                    ok = np.ones(len(h), dtype=bool)
                    for k in range(1, n):  # starts within n - 1 of their row's end
                        ends = own_off[1:] - k
                        ends = ends[(ends >= own_off[:-1]) & (ends < len(h))]
                        ok[ends] = False
                    flags[(base[: len(h)] + (((h + np.uint32(n)) * np.uint32(0x9E3779B1)) >> shift))[ok]] = True
        hit = np.flatnonzero(flags)
        yield at, np.searchsorted(hit, np.arange(rows + 1, dtype=np.int64) << bits), (hit & ((1 << bits) - 1)).astype(np.int32)


def row_sums(weights: np.ndarray, ptr: np.ndarray, features: np.ndarray) -> np.ndarray:
    """For each row the sum of its features' weights; weights may have columns."""
    out = np.zeros((len(ptr) - 1, *weights.shape[1:]))
    some = np.flatnonzero(ptr[:-1] < ptr[1:])
    if len(some):  # each row by itself, so equal rows have equal sums
        out[some] = np.add.reduceat(weights[features].astype(np.float64), ptr[:-1][some], axis=0)
    return out


def sample_features(texts: list[str | None], orders: tuple[int, ...], bits: int, prepare=lambda x: x) -> list[np.ndarray]:
    """The same features of a bounded list of texts, row by row."""
    out = []
    for _, buf, off in tn.slices(pa.array(texts, pa.string())):
        for _, ptr, features in presence(prepare(buf), off, orders, bits):
            out += [features[a:b] for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
    return out


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of doc_id as text, modulo ``of``."""
    return F.crc32(doc_id.cast("string")) % of


#: Bounds of a training sample's texts in bytes: of one text, and of all together.
MOST_TEXT, MOST_BYTES = 1 << 20, 48 << 20


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, each: bool = False, unlabelled: int = 0):
    """Rows (doc_id, text, label) of documents with a label, as pandas: at most ``most`` of them, and
    no more than MOST_BYTES of text; texts of more than MOST_TEXT bytes are not learnt from.

    The least hashes of doc_id are taken, so the choice doesn't follow the order of rows; with
    ``each`` an even share of every label. ``unlabelled`` more rows (label null) follow from docs
    whose doc_id isn't in labels. Those ids, a bounded number, are broadcast and texts are not
    shuffled before the choice. Of rows that repeat a doc_id the least text counts, and of labels
    that do the greatest; both are found before anything is collected.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label))
    first = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    if each:
        values = [r[0] for r in known.select(label).distinct().orderBy(label).limit(most).collect()]
        parts = [first(known.where(F.col(label) == v), max(1, most // len(values))) for v in values]
        ids = reduce(DataFrame.unionByName, parts) if parts else known.limit(0)
    else:
        ids = first(known, most)
    if unlabelled:
        others = docs.where("doc_id is not null").select("doc_id").distinct().join(labels.select("doc_id"), "doc_id", "left_anti")
        ids = ids.unionByName(first(others, unlabelled).withColumn(label, F.lit(None).cast(known.schema[label].dataType)))
    rows = docs.where("doc_id is not null").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= MOST_TEXT).join(F.broadcast(ids), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max(label).alias(label))
    # a window over all of the bounded sample
    upto = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    return rows.withColumn("upto", upto).where(F.col("upto") <= MOST_BYTES).drop("upto").toPandas().sort_values("doc_id", kind="stable")
