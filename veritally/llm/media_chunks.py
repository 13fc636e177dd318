"""Content-defined chunking of payloads, chunk de-duplication, and verified reconstruction.

A payload is a text's UTF-8 bytes and blanks (byte 32) up to a positive multiple of ALIGN: 8-bit
samples. A rolling gear hash over the last 32 samples cuts it where its top CUT_BITS bits are
zero, MIN_CHUNK to MAX_CHUNK samples after the last cut. Its stored form is the ordered chunk
list (magic, samples, chunks; of each chunk its length and digest); equal payloads have one.

Payload lists are told apart by SHA-256 and chunks by a 128-bit digest, with Spark joins. A
chunk that one payload alone holds lies beside that payload's list; a chunk with more places is
stored once, by the payload that comes first, and fetched by its digest where it is needed.

Most payloads share nothing with others and needn't meet the result of the joins: the documents
that do are put in a Bloom filter of a fixed size, which goes to all tasks. A document that isn't
in it is stored where it is read; those that may be are joined, and false alarms cost only that.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm.tables import drop, materialise

ALIGN, MIN_CHUNK, MAX_CHUNK, CUT_BITS = 192, 512, 16384, 11
_HEAD, _ENTRY = struct.Struct("<4sQI"), struct.Struct("<I16s")
_gear = np.random.default_rng(31).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Unpadded length and payload."""
    raw = (text or "").encode()
    return len(raw), raw + b" " * (max(1, -(-len(raw) // ALIGN)) * ALIGN - len(raw))


def cuts(payload: bytes) -> list[int]:
    """Ends of the chunks. The hash of a place depends on the 32 samples up to it alone."""
    h = _gear[np.frombuffer(payload, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    ends, last = [], 0
    for at in np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0).tolist():
        while at + 1 - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if at + 1 - last >= MIN_CHUNK:
            last = at + 1
            ends.append(last)
    while len(payload) - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    if last < len(payload):
        ends.append(len(payload))
    return ends


def chunks(payload: bytes) -> list[bytes]:
    ends = cuts(payload)
    return [payload[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def chunk_list(payload: bytes, parts: list[bytes] | None = None) -> bytes:
    parts = chunks(payload) if parts is None else parts
    return _HEAD.pack(b"CDC1", len(payload), len(parts)) + b"".join(_ENTRY.pack(len(c), digest(c)) for c in parts)


def read_list(stored: bytes) -> tuple[int, list[tuple[int, bytes]]]:
    """Samples, and length and digest of each chunk."""
    magic, size, n = _HEAD.unpack_from(stored)
    entries = [_ENTRY.unpack_from(stored, _HEAD.size + i * _ENTRY.size) for i in range(n)]
    if magic != b"CDC1" or len(stored) != _HEAD.size + n * _ENTRY.size or sum(x for x, _ in entries) != size:
        raise ValueError("not a chunk list")
    return size, entries


def rebuild(stored: bytes, parts: list[bytes]) -> bytes:
    """The payload from its list and its chunks in order; each is checked."""
    size, entries = read_list(stored)
    for (length, name), part in zip(entries, parts, strict=True):
        if len(part) != length or digest(part) != name:
            raise ValueError("a chunk differs from its list")
    return b"".join(parts)


def features(payload: bytes, stored: bytes) -> str:
    """Chunks, mean and deviation of the samples, and crossings of their middle."""
    x = np.frombuffer(payload, np.uint8)
    above = x > 110
    return f"chunks={len(read_list(stored)[1])};mean={x.mean():.3f};std={x.std():.3f};crossings={int((above[1:] != above[:-1]).sum())}"


def _scan(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, n, whole, lists = batch.column("doc_id"), [], [], []
            for text in batch.column("text"):
                size, payload = payload_of(text.as_py())
                n.append(size)
                whole.append(hashlib.sha256(payload).digest())
                lists.append([digest(c) for c in chunks(payload)])
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(whole, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], names=["doc_id", "n_bytes", "media", "names"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, media binary, names array<binary>")


FILTER_BITS, FILTER_HASHES = 1 << 24, 4


def _filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of doc_ids, FILTER_BITS long whatever their number."""
    places = F.explode(F.array(*[F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(FILTER_BITS)) for k in range(FILTER_HASHES)]))
    words = ids.select(places.alias("p")).groupBy(F.shiftright("p", 5).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("bits"))
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    found = words.toPandas()
    out[found["w"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def _places(docs: DataFrame) -> DataFrame:
    return docs.withColumn("at", F.array(*[F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(FILTER_BITS)).cast("int") for k in range(FILTER_HASHES)]))


def _maybe(batch: pa.RecordBatch, bits: np.ndarray) -> np.ndarray:
    """Rows that may be in the filter; all without a doc_id."""
    at = batch.column("at").flatten().to_numpy().reshape(-1, FILTER_HASHES)
    inside = (bits[at >> 5] >> (at & 31).astype(np.uint32) & 1).all(axis=1)
    return inside | batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)


_STORED = "media binary, list binary, name binary, body binary, shared array<int>"


def _stored(rows) -> pa.RecordBatch:
    """From (media or null, text, shared: place and owner of chunks with more places): what is stored.

    One row per payload: media, list, body (its own chunks in order), shared (those elsewhere);
    one row per shared chunk that it owns: name, body.
    """
    out = [[], [], [], [], []]
    for media, text, shared in rows:
        _, payload = payload_of(text)
        whole = hashlib.sha256(payload).digest()
        if media is not None and whole != media:
            continue  # another row of the same doc_id
        elsewhere = {s["place"]: s["owner"] for s in shared or []}
        parts = chunks(payload)
        own = [c for i, c in enumerate(parts) if i not in elsewhere]
        for row in [(whole, chunk_list(payload, parts), None, b"".join(own), sorted(elsewhere))] + [(None, None, digest(parts[i]), parts[i], None) for i, owner in sorted(elsewhere.items()) if owner]:
            for column, value in zip(out, row, strict=True):
                column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32())), strict=True)], names=["media", "list", "name", "body", "shared"])


def _in_place(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """What is stored of the documents that are not in the filter."""

    def run(batches):
        for batch in batches:
            alone = batch.filter(pa.array(~_maybe(batch, bits)))
            for at in range(0, alone.num_rows, 1000):
                yield _stored((None, t.as_py(), None) for t in alone.column("text").slice(at, 1000))

    return _places(docs).mapInArrow(run, _STORED)


def _joined(docs: DataFrame, plan: DataFrame, bits: np.ndarray) -> DataFrame:
    """What is stored of the others, once they have met the plan of their payload."""

    def some(batches):
        for batch in batches:
            yield batch.filter(pa.array(_maybe(batch, bits))).select(["doc_id", "text"])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield _stored(zip(*(part.column(c).to_pylist() for c in ("media", "text", "shared")), strict=True))

    docs = _places(docs).mapInArrow(some, "doc_id long, text string")
    rows = docs.join(plan.where("doc_id is not null"), "doc_id").select("media", "text", "shared")
    alone = plan.where("doc_id is null")  # payloads of rows without doc_id only: found by their hash
    if alone.limit(1).count():
        text = F.coalesce("text", F.lit(""))
        blanks = F.greatest(F.lit(1), F.ceil(F.octet_length(text) / ALIGN)) * ALIGN - F.octet_length(text)
        padded = F.unhex(F.sha2(F.concat(F.encode(text, "UTF-8"), F.encode(F.repeat(F.lit(" "), blanks.cast("int")), "UTF-8")), 256))
        rows = rows.unionByName(docs.where("doc_id is null").withColumn("media", padded).join(alone.drop("doc_id"), "media").dropDuplicates(["media"]).select("media", "text", "shared"))
    return rows.mapInArrow(run, _STORED)


def _read(rows: DataFrame) -> DataFrame:
    """Payloads rebuilt from media, list, body, shared and fetched (place, body); checked."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            for media, stored, body, fetched in zip(*(batch.column(c).to_pylist() for c in ("media", "list", "body", "fetched")), strict=True):
                elsewhere, at, parts = {f["place"]: f["body"] for f in fetched or []}, 0, []
                for i, (length, _) in enumerate(read_list(stored)[1]):
                    if i in elsewhere:
                        parts.append(elsewhere[i])
                    else:
                        parts.append(body[at : at + length])
                        at += length
                payload = rebuild(stored, parts)
                if hashlib.sha256(payload).digest() != media:
                    raise ValueError("a payload differs from what was stored")
                for column, value in zip(out, (media, len(payload), media.hex(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), features(payload, stored)), strict=True):
                    column.append(value)
            kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return rows.mapInArrow(run, "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, n_bytes, media; the store of lists and chunks), both written."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = materialise(_scan(docs), "scan")
    # each distinct payload is written from one of its rows (one without doc_id if there is no other)
    payloads = materialise(seen.groupBy("media").agg(F.min("doc_id").alias("doc_id"), F.first("names").alias("names"), F.count("*").alias("rows")), "payloads")
    places = payloads.select("media", F.posexplode("names").alias("place", "name"))
    twice = materialise(places.groupBy("name").agg(F.count("*").alias("n"), F.min(F.struct("media", "place")).alias("owner")).where("n > 1").select("name", "owner"), "twice")
    shared = places.join(twice, "name").select("media", F.struct("place", (F.struct("media", "place") == F.col("owner")).alias("owner")).alias("s"))
    shared = materialise(shared.groupBy("media").agg(F.collect_list("s").alias("shared")), "places")
    plan = materialise(payloads.select("media", "doc_id", "rows").join(shared, "media", "left"), "plan")
    bits = _filter(seen.select("doc_id", "media").join(plan.where("rows > 1 or shared is not null").select("media"), "media").where("doc_id is not null"))
    out = materialise(_in_place(docs, bits).unionByName(_joined(docs, plan.drop("rows"), bits)), "store", "zstd")
    drop(payloads, twice, shared, plan)
    return seen.select("doc_id", "n_bytes", "media"), out


def read_back(stored: DataFrame) -> DataFrame:
    """media and the figures of every payload, from the stored rows alone."""
    lists = stored.where("media is not null")
    whole = lists.where("size(shared) = 0").select("media", "list", "body", F.lit(None).cast("array<struct<place:int,body:binary>>").alias("fetched"))
    some = lists.where("size(shared) > 0")
    named = some.select("media", F.explode("shared").alias("place"), F.expr(f"substring(list, {_HEAD.size + 5} + place * {_ENTRY.size}, 16)").alias("name"))
    parts = named.join(stored.where("name is not null").select("name", "body"), "name").groupBy("media").agg(F.collect_list(F.struct("place", "body")).alias("fetched"))
    return _read(whole.unionByName(some.select("media", "list", "body").join(parts, "media")))


def chunked_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    One row per row of docs (doc_id, text, ...), all but the first two from what was read back.
    A null text is an empty one. Rows that repeat a doc_id, or lack it, are returned each. Other
    columns are ignored; an empty table gives an empty result.
    """
    seen, stored = store(docs)
    figures = materialise(read_back(stored).dropDuplicates(["media"]), "figures")
    drop(stored)
    return seen.join(figures, "media").drop("media")
