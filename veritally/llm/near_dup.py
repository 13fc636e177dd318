"""MinHash near-duplicates by a signature-coordinate inverted join.

Every distinct shingle set posts its signature under each (coordinate, value). Values that one
set alone holds are dropped; a set with too few shared coordinates to reach the match threshold
is skipped whole, and any other keeps only its prefix: the rarest ``coordinates - matches + 1``
coordinates, of which every pair over the threshold shares one. Pairs from these short lists
are counted over all coordinates, kept from ``matches`` on, and confirmed on full shingle sets.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm import textnum as tn
from veritally.llm.linking import link
from veritally.llm.tables import drop, materialise, only_ids

#: A pair at the threshold has fewer than ``_matches`` coordinates in common with a chance of
#: MISS at most: at 0.85 under 40 of 64, at 0.80 under 35. A group of copies has many paths, so it
#: is lost more rarely still.
COORDINATES, MISS = 64, 2.5e-6
#: Bits of a set's parity sketch: each shingle flips one. Two sets differ in at least as many
#: shingles as their sketches differ in bits, so the filter on it loses no link.
PARITY = 1024

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)


def _matches(percent: int) -> int:
    """The most matches to ask for so that a pair at the threshold falls below with a chance of MISS at most."""
    p, below = percent / 100, 0.0
    for m in range(COORDINATES):
        below += comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)
        if below > MISS:
            if m == 0:
                raise ValueError(f"{COORDINATES} coordinates are too few for a similarity of {percent} %")
            return m
    return COORDINATES


def _signature(shingles: np.ndarray) -> np.ndarray:
    """The least of each coordinate's hash over a set; the set in blocks that fit a cache."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 512):
            h = shingles[at : at + 512, None] * _MUL
            h += _ADD
            np.minimum(least, h.min(axis=0), out=least)
    return least


def _sets(batch: pa.RecordBatch, size: int):
    """(row, sorted distinct shingle hashes) of every row with a word."""
    for first, buf, off in tn.slices(batch.column("text")):
        low = tn.lowered(buf)
        s, e, ptr = tn.words(low, off)
        sh, at = tn.shingle_hashes(tn.span_hashes(low, s, e), ptr, size)
        for k in np.flatnonzero(np.diff(at)):
            yield first + int(k), np.unique(sh[at[k] : at[k + 1]])


def signatures(docs: DataFrame, size: int = tn.SHINGLE) -> DataFrame:
    """doc_id, n_shingles, f1 and f2 (a fingerprint of the set), sig and parity (null for an empty set)."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            count, f = np.zeros(n, np.int64), np.zeros((2, n), np.uint64)
            sig, parity, has = np.zeros((n, COORDINATES), np.uint64), np.zeros((n, PARITY // 64), np.uint64), np.zeros(n, bool)
            for row, own in _sets(batch, size):
                count[row], has[row] = len(own), True
                sig[row] = _signature(own)
                parity[row] = np.packbits(np.bincount((own % np.uint64(PARITY)).astype(np.int64), minlength=PARITY).astype(np.uint8) & 1).view(np.uint64)
                with np.errstate(over="ignore"):
                    f[0, row], f[1, row] = own.sum(dtype=np.uint64), tn.mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has) * x.shape[1]]).astype(np.int32)), pa.array(x[has].view(np.int64).ravel()), mask=pa.array(~has)) for x in (sig, parity)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count), pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)), *lists], names=["doc_id", "n_shingles", "f1", "f2", "sig", "parity"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, sig array<long>, parity array<long>")


def _shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            rows, sets = [], []

            def out():
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                return pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["node", "shingles"])

            held = 0
            for row, own in _sets(batch, size):
                rows.append(row)
                sets.append(own)
                held += len(own)
                if held > 1 << 20:
                    yield out()
                    rows, sets, held = [], [], 0
            if rows:
                yield out()

    return docs.mapInArrow(run, "node long, shingles array<long>")


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = tn.SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text, ...).

    Rows are linked where 100 * |intersection| >= percent * |union| of their distinct shingles
    of ``size`` words (A-Z lower-cased; words are runs without white space). A row with fewer
    words has one shingle, the whole; a null or blank text has none and is linked with nothing.
    component_id is the smallest doc_id reachable; kept tells doc_id = component_id. Rows that
    repeat a doc_id are one document for linking, each returned. A row without doc_id is
    returned with a null component_id and kept, linked with nothing. Other columns are ignored;
    an empty table gives an empty result. A pair at the threshold is missed with a chance of
    ``MISS`` at most, whatever percent is; below 19 there are too few coordinates (ValueError).
    """
    matches = _matches(percent)
    all_rows = materialise(signatures(docs, size), "signatures")
    # sets that are equal are one class, whose least document stands for it
    classes = all_rows.where("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2", "n_shingles").agg(F.min_by(F.struct("sig", "parity"), "doc_id").alias("one"), F.min("doc_id").alias("node"))
    classes = materialise(classes.select("f1", "f2", "n_shingles", "node", "one.sig", "one.parity"), "classes")
    posts = classes.select("node", F.explode("sig").alias("key"))
    shared = materialise(posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    # skip: a set with fewer shared coordinates than matches has no partner
    prefix = posts.join(shared, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("own"), F.sum("n").alias("pri")).where(F.size("own") >= matches)
    prefix = prefix.join(classes.select("node", F.col("n_shingles").alias("size")), "node")
    prefix = materialise(prefix.select("node", "pri", "size", F.explode(F.array_distinct(F.slice("own", 1, F.size("own") - matches + 1))).alias("post")).select(F.col("post.key").alias("key"), "node", "pri", "size"), "prefix")
    drop(shared)
    nodes = prefix.select(F.col("node").alias("doc_id")).distinct()
    texts = only_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), nodes, ["doc_id", "text"], "texts")
    sets = materialise(_shingle_sets(texts, size), "sets")
    drop(texts)

    def close(x: str, y: str, sizes: str) -> str:
        apart = " + ".join(f"bit_count({x}[{i}] ^ {y}[{i}])" for i in range(PARITY // 64))
        return f"{100 + percent} * ({apart}) <= {100 - percent} * ({sizes})"

    def near(pairs: DataFrame) -> DataFrame:
        """By sizes and parity sketches alone; true of every pair to be linked."""
        of = lambda x: classes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("parity").alias(f"p_{x}"))
        return pairs.join(of("a"), "a").join(of("b"), "b").where(close("p_a", "p_b", "n_a + n_b")).select("a", "b")

    def verify(pairs: DataFrame) -> DataFrame:
        of = lambda x: classes.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"))
        close = pairs.join(of("a"), "a").join(of("b"), "b").where(f"size(array_intersect(sig_a, sig_b)) >= {matches}")
        full = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}"))
        both = close.select("a", "b").join(full("a"), "a").join(full("b"), "b").withColumn("same", F.size(F.array_intersect("s_a", "s_b")))
        return both.where(f"100 * same >= {percent} * (size(s_a) + size(s_b) - same)").select("a", "b").distinct()

    found = link(prefix, verify, percent / 100, near, classes.select("node", F.col("parity").alias("sketch")), F.expr(close("sketch", "other_sketch", "size + other_size")))
    drop(prefix, sets)
    of_class = materialise(classes.select("f1", "f2", "n_shingles", "node").join(found, "node", "left").select("f1", "f2", F.col("n_shingles").alias("n"), F.coalesce("component", "node").alias("component")), "members")
    drop(classes, found)
    out = all_rows.select("doc_id", "n_shingles", "f1", "f2").join(of_class, (all_rows.f1 == of_class.f1) & (all_rows.f2 == of_class.f2) & (F.col("n_shingles") == F.col("n")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))
