"""Conflict-constrained best-fit packing of documents into bins of equal capacity.

Documents are dealt by hash to shards of about SHARD_DOCS, each packed on its own: a bin never
crosses shards, so more data makes more shards and not larger ones, and no source or cluster
gathers in one. Within a shard, longest first, a document goes to the tightest bin that has
room and no conflict: bins stand in order of residual with a bitmap of the sources and one of
the duplicate clusters they hold, and the search runs from the first residual that fits to its
successors until the bitmaps allow one; else a bin is opened.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritally.llm import textnum as tn
from veritally.llm.tables import materialise

CAPACITY, SHARD_DOCS = 2048, 4096


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens (words of the whole text and an end mark), cluster (of equal words)."""

    def run(batches):
        for batch in batches:
            n, cluster = np.ones(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64)
            for first, buf, off in tn.slices(batch.column("text")):
                low = tn.lowered(buf)
                s, e, ptr = tn.words(low, off)
                n[first : first + len(off) - 1] += np.diff(ptr)
                with np.errstate(over="ignore"):
                    word = tn.span_hashes(low, s, e)
                    place = np.arange(len(word), dtype=np.uint64) - np.repeat(ptr[:-1], np.diff(ptr)).astype(np.uint64)
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(tn.mix(word + place * np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)])
                    cluster[first : first + len(off) - 1] = tn.mix(sums[ptr[1:]] - sums[ptr[:-1]])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(n), pa.array(cluster.view(np.int64))], names=["doc_id", "source", "n_tokens", "cluster"])

    kinds = [docs.schema["doc_id"], T.StructField("source", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("cluster", T.LongType())]
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source")).mapInArrow(run, T.StructType(kinds))


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """The bin of each item, in the order given. A negative source or cluster is in no conflict."""
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    held: list[list[int]] = []  # of each bin: bitmap of sources, bitmap of clusters
    out = []
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        at = bisect_left(order, (length, -1))
        while at < len(order) and (held[order[at][1]][0] & s or held[order[at][1]][1] & c):
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
            residual -= length
        else:
            residual, b = capacity - length, len(held)
            held.append([0, 0])
        held[b][0] |= s
        held[b][1] |= c
        if residual:
            at = bisect_left(order, (residual, b))
            order.insert(at, (residual, b))
        out.append(b)
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS, cluster: str | None = None) -> DataFrame:
    """shard, bin, doc_id, piece, start, n_tokens, bin_start of every piece of every row of docs.

    A row of more than ``capacity`` tokens is cut in pieces; all but the last fill a bin each. A
    bin holds at most ``capacity`` tokens, and of one source and of one duplicate cluster at
    most one piece (full pieces have a bin to themselves). Clusters are rows of equal words, or
    equal values of the column ``cluster``. start is the piece's first token in its document,
    bin_start its first in the bin. A null or empty text is its end mark alone. A null source or
    cluster is in no conflict. Rows that repeat a doc_id are packed each; so are rows without
    one. Ties go by doc_id, then cluster; of a doc_id whose rows differ in the column ``cluster``
    the least value counts for all. Other columns are ignored. An empty table gives an empty result.
    """
    rows = measured(docs)
    if cluster is not None:
        of = docs.groupBy("doc_id").agg(F.min(F.col(cluster).cast("string")).alias("cluster"))
        rows = rows.drop("cluster").join(of, "doc_id", "left")
    shards = max(1, -(-docs.count() // shard_docs))
    # rows that repeat too often for one shard are dealt one by one
    rows = materialise(rows.withColumn("_key", F.xxhash64("doc_id", "n_tokens", "cluster")).withColumn("_row", F.monotonically_increasing_id()), "measured")
    often = rows.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") > max(1, shard_docs // 8))
    rows = rows.join(often, "_key", "left").withColumn("shard", F.pmod(F.when(F.col("_n").isNotNull(), F.xxhash64("_key", "_row")).otherwise(F.col("_key")), F.lit(shards)))
    id_type = docs.schema["doc_id"].dataType

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(rest=(pdf["n_tokens"] - 1) % capacity + 1).sort_values(["rest", "doc_id", "cluster", "source"], ascending=[False, True, True, True], kind="stable")
        clusters, repeated = np.full(len(pdf), -1), pdf["cluster"].duplicated(keep=False).to_numpy()
        clusters[repeated] = pd.factorize(pdf["cluster"][repeated])[0]
        bins = best_fit(pdf["rest"].tolist(), pd.factorize(pdf["source"])[0].tolist(), clusters.tolist(), capacity)
        pdf = pdf.assign(bin=bins, piece=(pdf["n_tokens"] - 1) // capacity, start=pdf["n_tokens"] - pdf["rest"])
        pdf["bin_start"] = pdf.groupby("bin")["rest"].cumsum() - pdf["rest"]
        full = pdf.loc[pdf.index.repeat(pdf["piece"]), ["shard", "doc_id"]]
        full["piece"] = full.groupby(level=0).cumcount()
        full = full.assign(start=full["piece"] * capacity, rest=capacity, bin_start=0, bin=np.arange(len(full)) + (max(bins) + 1 if bins else 0))
        return pd.concat([pdf, full])[["shard", "bin", "doc_id", "piece", "start", "rest", "bin_start"]].rename(columns={"rest": "n_tokens"})

    names = [("shard", T.LongType()), ("bin", T.LongType()), ("doc_id", id_type), ("piece", T.LongType()), ("start", T.LongType()), ("n_tokens", T.LongType()), ("bin_start", T.LongType())]
    return rows.groupBy("shard").applyInPandas(run, T.StructType([T.StructField(*x) for x in names]))
