"""Array helpers over whole Arrow text columns: words, word hashes, shingles, n-grams.

Everything works on one contiguous UTF-8 buffer at a time, a slice of a batch of about
``SLICE`` bytes (or one longer document), so memory follows the slice and not the batch.
A null text is an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
SHINGLE = 5

#: Odd multipliers of the hashes below.
_BASE = 0x9E3779B97F4A7C15
_WORD = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
_LENGTH = np.uint64(0x8EBC6AF09C88C6E3)
#: Masks of a block's first 0 to 8 bytes.
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)

_space = np.zeros(256, dtype=bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of rows in them and their end) for runs of rows."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, side="right")) - 1)
        to = min(to, len(texts))
        yield at, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes as they are."""
    return _lower[buf]


def lowered_latin(buf: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the capitals of Latin-1 (two UTF-8 bytes, the first 0xC3)."""
    out = _lower[buf]
    if len(out) > 1:
        at = np.flatnonzero((out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)) + 1
        out[at] += 0x20
    return out


def spans(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of member bytes within rows: starts, ends, and the row pointer into them."""
    start, end = member.copy(), member.copy()
    if len(member):
        start[1:] &= ~member[:-1]
        end[:-1] &= ~member[1:]
        own = off[:-1][off[:-1] < off[1:]]
        start[own] = member[own]
        last = off[1:][off[:-1] < off[1:]] - 1
        end[last] = member[last]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, off)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than space and \\x09-\\x0D."""
    return spans(~_space[buf], off)


def _blocks(words: np.ndarray, at: np.ndarray, left: np.ndarray, place: np.ndarray | int) -> np.ndarray:
    """A hash of up to 8 bytes at each place, told apart by the block's place in its span."""
    h = words[at] & _HEAD[np.minimum(left, 8)]
    h ^= np.asarray(place, np.uint64) * np.uint64(_BASE) + _WORD[4]
    h *= _WORD[0]
    h ^= h >> np.uint64(32)
    h *= _WORD[1]
    h ^= h >> np.uint64(29)
    return h


def span_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each buf[s:e]; equal bytes, equal hash.

    Blocks of 8 bytes are mixed before they are summed. (A polynomial modulo 2**64 would not do:
    there are spans that collide whatever its base.)
    """
    if not len(s):
        return np.zeros(0, np.uint64)
    n = e - s
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.ndarray((len(buf) + 1,), "<u8", padded.data, 0, (1,))
    with np.errstate(over="ignore"):
        total = n.astype(np.uint64) * _LENGTH
        for j in range(4):
            at = slice(None) if j == 0 else np.flatnonzero(n > 8 * j)
            if j and not len(at):
                break
            total[at] += _blocks(words, s[at] + 8 * j, n[at] - 8 * j, j)
        long = np.flatnonzero(n > 32)
        if len(long):
            count = (n[long] - 25) // 8  # blocks from the fifth on
            first = np.cumsum(count) - count
            place = np.arange(count.sum()) - np.repeat(first, count) + 4
            own = np.repeat(long, count)
            total[long] += np.add.reduceat(_blocks(words, s[own] + 8 * place, n[own] - 8 * place, place), first)
        return mix(total)


def shingle_hashes(word: np.ndarray, ptr: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's word runs of ``size`` (with repeats), and the row pointer.

    A row of fewer words has one: its whole sequence. A row without words has none.
    """
    n = np.diff(ptr)
    each = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    out_ptr = np.concatenate([[0], np.cumsum(each)])
    if not len(word):
        return np.zeros(0, np.uint64), out_ptr
    with np.errstate(over="ignore"):
        padded = np.concatenate([word, np.zeros(size, np.uint64)])
        at = np.repeat(ptr[:-1] - out_ptr[:-1], each) + np.arange(out_ptr[-1])
        full = np.zeros(len(word), np.uint64)
        for j in range(size):
            full += padded[j : j + len(word)] * _WORD[j % len(_WORD)]
        full = full[at]
        for row in np.flatnonzero((n > 0) & (n < size)):
            full[out_ptr[row]] = np.uint64(n[row]) * _LENGTH + (word[ptr[row] : ptr[row + 1]] * _WORD[: n[row]]).sum(dtype=np.uint64)
        return mix(full), out_ptr
