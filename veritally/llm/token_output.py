"""Token ids of whole documents in range-coded blocks, in ascending doc_id order.

Documents are range-partitioned by doc_id and sorted; each partition encodes its texts and
writes blocks of up to BLOCK_IDS ids (whole documents; a longer document is a block). A row of
the written table is one block: part (the partition, ascending in doc_id), block (its number in
the part), and data, which stands alone: a document directory and the coded ids, both with
checksums. Places of documents follow from what the blocks hold when they are read: running sums
over the blocks of a part, and over the few rows of part totals.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritally.llm import range_coder
from veritally.llm import textnum as tn
from veritally.llm.tables import materialise

BLOCK_IDS, END_ID = 1 << 21, 2
_DIRECTORY = struct.Struct("<4sIII")
#: Units kept with their ids by each worker; then it starts anew. Bytes of texts whose units are numbered together.
KEPT_UNITS, TOGETHER = 1_000_000, 8 << 20

_WHITE = b"\t\n\x0b\x0c\r "
_white = np.zeros(256, dtype=bool)
_white[list(_WHITE)] = True
#: ASCII letters and digits, and the marks of ASCII.
_alnum = np.array([chr(k).isalnum() and k < 128 for k in range(256)])
_mark = np.array([32 < k < 127 and not chr(k).isalnum() for k in range(256)])


def _odd(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows with white space of more than a byte, \\x1c-\\x1f, or the start of a special token's string."""
    out = np.zeros(len(off) - 1, dtype=bool)
    if len(buf) < 2:
        return out | bool(len(buf) and 28 <= buf[0] <= 31)
    lead = np.flatnonzero(((buf >= 28) & (buf <= 31)) | (buf == 60) | (buf == 0xC2) | ((buf >= 0xE1) & (buf <= 0xE3)))
    x, y, z = buf[lead], buf[np.minimum(lead + 1, len(buf) - 1)], buf[np.minimum(lead + 2, len(buf) - 1)]
    hit = (x < 32) | ((x == 60) & (y == 124)) | ((x == 0xC2) & ((y == 0x85) | (y == 0xA0))) | ((x == 0xE1) & (y == 0x9A) & (z == 0x80)) | ((x == 0xE3) & (y == 0x80) & (z == 0x80))
    hit |= (x == 0xE2) & (((y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))) | ((y == 0x81) & (z == 0x9F)))
    out[np.searchsorted(off, lead[hit], side="right") - 1] = True
    return out


class Encoder:
    """Ids of texts by a byte-level BPE of the tokenizers library.

    Its pre-tokens never join what comes before white space with that white space, nor a letter
    or digit with a mark after it, so a text is the run of its units' ids, a unit being white
    space and the word after it, or marks and what follows them. The library encodes each unit
    once while it is kept, under its bytes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()  # a character of a byte-level token is a byte
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ends, self.pool = np.zeros(1, np.int64), np.zeros(0, np.uint16)

    def _keep(self, raw: list[bytes]) -> None:
        """Encodes new units and keeps their ids.

        Words after white space are encoded as one text, whose ids are dealt to them by the bytes
        that each id stands for.
        """
        led, rest = [], []
        for x in raw:
            (led if x[0] in _WHITE and x[-1] not in _WHITE else rest).append(x)
        ids, count = [self.pool], []
        for at in range(0, len(led), 8192):
            own = led[at : at + 8192]
            ids.append(np.array(self.library.encode_batch_fast([b"".join(own).decode()], add_special_tokens=False)[0].ids, np.uint16))
            ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
            count.append(np.diff(np.searchsorted(np.cumsum(self.width[ids[-1]]), ends) + 1, prepend=0))
        single = [x.ids for x in self.library.encode_batch_fast([x.decode() for x in rest], add_special_tokens=False)]
        ids += [np.array(x, np.uint16) for x in single]
        count = np.concatenate([*count, np.fromiter(map(len, single), np.int64, len(single))])
        self.number.update(zip(led + rest, range(len(self.number), len(self.number) + len(raw)), strict=True))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(count)])
        self.pool = np.concatenate(ids)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, without an end id; a null is an empty text."""
        for _, buf, off in tn.slices(texts, TOGETHER):
            odd = _odd(buf, off)
            white = _white[buf]
            first = np.zeros(len(buf), dtype=bool)
            first[1:] = (white[1:] & ~white[:-1]) | (_mark[buf[1:]] & _alnum[buf[:-1]])
            first[off[:-1][off[:-1] < off[1:]]] = True
            s = np.flatnonzero(first)
            ptr = np.searchsorted(s, off)
            # Arrow numbers the units; each different one is looked up once
            units = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(np.append(s, len(buf))), pa.py_buffer(buf)]).dictionary_encode()
            kinds = units.dictionary.to_pylist()
            if len(self.number) > KEPT_UNITS:
                self.clear()
            number = list(map(self.number.get, kinds))
            if None in number:
                new = [k for k, x in enumerate(number) if x is None]
                self._keep([kinds[k] for k in new])
                for k in new:
                    number[k] = self.number[kinds[k]]
            index = np.array(number, np.int64)[units.indices.to_numpy()]
            start = self.ends[index]
            count = self.ends[index + 1] - start
            total = np.concatenate([[0], np.cumsum(count)])
            ids = self.pool[np.repeat(start - total[:-1], count) + np.arange(total[-1])]
            for row in range(len(off) - 1):
                if odd[row]:
                    text = buf[off[row] : off[row + 1]].tobytes().decode()
                    yield np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint16)
                else:
                    yield ids[total[ptr[row]] : total[ptr[row + 1]]]


_encoders: dict[str, Encoder] = {}


def write_block(doc_ids: list[int | None], ids: list[np.ndarray], vocab: int) -> bytes:
    """Directory (null flags, doc ids, counts; deflated, with its checksum) and coded ids."""
    null = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([d or 0 for d in doc_ids], np.int64)
    raw = zlib.compress(null.tobytes() + np.diff(keys, prepend=0).astype("<i8").tobytes() + np.array([len(x) for x in ids], "<i8").tobytes(), 6)
    return _DIRECTORY.pack(b"TOK1", len(doc_ids), len(raw), zlib.crc32(raw)) + raw + range_coder.encode(np.concatenate(ids) if ids else np.zeros(0, np.int64), vocab)


def read_block(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc ids, pointer of documents into the ids, ids; ValueError if damaged."""
    magic, n, size, crc = _DIRECTORY.unpack_from(data)
    raw = data[_DIRECTORY.size : _DIRECTORY.size + size]
    if magic != b"TOK1" or len(raw) != size or zlib.crc32(raw) != crc:
        raise ValueError("damaged directory")
    raw = zlib.decompress(raw)
    keys = np.cumsum(np.frombuffer(raw, "<i8", n, n))
    ptr = np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<i8", n, 9 * n))])
    ids = range_coder.decode(data[_DIRECTORY.size + size :])
    if ptr[-1] != len(ids):
        raise ValueError("directory and ids differ")
    return [None if x else int(k) for x, k in zip(raw[:n], keys, strict=True)], ptr, ids


def write(docs: DataFrame, tokenizer: str, vocab: int = 50258, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """part, block, n_ids, data of docs (doc_id, text, ...), written. tokenizer: path of its file."""

    def run(batches):
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, Encoder(tokenizer))
        part, block = TaskContext.get().partitionId(), 0
        keys, held, size = [], [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([size], pa.int64()), pa.array([write_block(keys, held, vocab)], pa.binary())], names=["part", "block", "n_ids", "data"])

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text")), strict=True):
                if size and size + len(ids) + 1 > block_ids:
                    yield out()
                    keys, held, size, block = [], [], 0, block + 1
                keys.append(doc_id)
                held.append(np.append(ids, ids.dtype.type(end_id)))
                size += len(ids) + 1
        if keys:
            yield out()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(ordered.mapInArrow(run, "part long, block long, n_ids long, data binary"), "tokens")


def read(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the written blocks."""

    def run(batches):
        for batch in batches:
            for part, block, data in zip(batch.column("part"), batch.column("block"), batch.column("data"), strict=True):
                keys, ptr, ids = read_block(data.as_py())
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)]
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * n, pa.int64()), pa.array([block.as_py()] * n, pa.int64()), pa.array(keys, pa.int64()), pa.array(ptr[:-1]), pa.array(np.diff(ptr)), pa.array(crc, pa.int64())], names=["part", "block", "doc_id", "place", "n_tokens", "ids_crc32"])

    docs = materialise(blocks.select("part", "block", "data").mapInArrow(run, "part long, block long, doc_id long, place long, n_tokens long, ids_crc32 long"), "read")
    sizes = docs.groupBy("part", "block").agg(F.sum("n_tokens").alias("n_ids"))
    within = sizes.withColumn("before", F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids"))
    # one row a partition: few, however many documents there are
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    base = within.join(parts.select("part", "base"), "part").select("part", "block", (F.col("base") + F.col("before")).alias("base"))
    return docs.join(base, ["part", "block"]).select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def token_blocks(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of docs, read back from the written blocks.

    A null or empty text is the end id alone. Rows that repeat a doc_id follow each other in
    order of their texts; rows without one come first. An empty table gives an empty result.
    Other columns are ignored.
    """
    return read(write(docs, tokenizer))
