"""Fuzzy line de-duplication: SimHash, pigeonhole blocks, edit similarity, connected groups.

A line is normalised to lower case with single blanks between its words; figures and marks stay.
Lines of equal normal form are one node; a line without words is blank and never a duplicate.
Two nodes are linked where their edit similarity, 1 - distance / longer length in characters, is
SIMILARITY or more and they agree in a block of their SimHash. Of every connected group the first
occurrence by (doc_id, line number) stays.

The SimHash has BLOCKS blocks of 64 bits. In each the line's features (runs of RUN words) vote
with weights that are the block's own and fall so steeply that the heaviest feature outvotes all
others together: a block is that feature's hash. Under equal weights an edit moves bits all over
the hash, and lines of similarity 0.9 are 4 to 9 of 64 bits apart, too far for pigeonhole blocks
that tell millions of lines apart; under steep ones it moves some blocks and leaves the others
whole, which is what the pigeonhole needs. Lines of up to FEW words have too few runs for that
and have further blocks: their words with one left out, and halves of their characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm import edits
from veritally.llm import textnum as tn
from veritally.llm.linking import band_of, link
from veritally.llm.tables import bloom_filters, drop, free, marked, materialise

SIMILARITY, BLOCKS, RUN, FEW = 0.9, 6, 3, 10
#: Bits of a line's sketch, and from how many characters on it has four times as many.
PARITY, LONG, FLIPS = 256, 160, 6
#: Finer sketches are of runs of so many characters, in 6 to 12 bits a character and 512 to 2^16 a line.
FINE, FINE_BITS = 5, (9, 16)
#: Characters of the pairs, or of the members of lists, that one group verifies.
CELL = 1 << 23
#: Members of a list that are compared in one cell, and pairs that are looked at together.
MEMBERS, PAIRS = 512, 1 << 18
#: Pairs that one group of cells has about, and members of each cell that meet the others first.
GROUP, FIRST = 1 << 21, 4

_rng = np.random.default_rng(20260301)
#: Each block's weights: a feature weighs the more, the less its hash times the block's factor.
_BLOCK = _rng.integers(1, 1 << 63, BLOCKS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _lines(buf: np.ndarray, off: np.ndarray):
    """Lower-case bytes, starts of all lines, their rows and numbers; starts and ends of words, and
    the pointer of lines into them."""
    low = tn.lowered_latin(buf)
    breaks = np.flatnonzero(buf == 10)
    rows = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, breaks, side="right") - 1])
    starts = np.concatenate([off[:-1], breaks + 1])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    number = np.arange(len(starts)) - np.searchsorted(rows, rows, side="left")
    s, e, _ = tn.words(low, off)
    # a word starts in the last line that starts before it; empty rows start no word
    line = np.searchsorted(starts, s, side="right") - 1
    return low, starts, rows, number, s, e, np.searchsorted(line, np.arange(len(starts) + 1))


def _nodes(word: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each line's words in their order; no line is without words."""
    with np.errstate(over="ignore"):
        place = np.arange(len(word), dtype=np.uint64) - np.repeat(ptr[:-1], np.diff(ptr)).astype(np.uint64)
        term = tn.mix(word + place * np.uint64(0x9E3779B97F4A7C15))
        return tn.mix(np.add.reduceat(term, ptr[:-1])), np.add.reduceat(term * (term >> np.uint64(32)), ptr[:-1]) >> np.uint64(33)


def _keys(low: np.ndarray, s: np.ndarray, e: np.ndarray, word: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, pointer): the distinct blocks of each line. No line is without words."""
    n = np.diff(ptr)
    runs, run_ptr = tn.shingle_hashes(word, ptr, RUN)
    line, keys = [], []
    with np.errstate(over="ignore"):
        for factor in _BLOCK:
            heaviest = np.minimum.reduceat(runs * factor, run_ptr[:-1])
            keys.append(heaviest * factor + factor)  # the block's own keys
            line.append(np.arange(len(n)))
        few = np.flatnonzero((n <= FEW) & (n > 1))
        term = tn.mix(word + np.uint64(0x2545F4914F6CDD1D))
        own = np.repeat(np.arange(len(n)), n)
        sums = np.add.reduceat(term, ptr[:-1])
        one = np.flatnonzero((n <= FEW)[own] & (n > 1)[own])
        keys += [tn.mix(sums[own[one]] - term[one] + np.uint64(1)), tn.mix(sums[few] + np.uint64(1))]
        line += [own[one], few]
        few = np.flatnonzero(n <= FEW)
        form, at = _forms(low, s, e, ptr, few)
        a, b = at[:-1], at[1:] - 1
        long = b - a >= 10  # shorter ones allow no edit
        a, b, few = a[long], b[long], few[long]
        half = (b - a) // 2
        for size in (half - 1, half, half + 1):  # halves for the own length, one less and one more
            keys += [tn.span_hashes(form, a, a + size) ^ np.uint64(0x9FB21C651E98DF25), tn.span_hashes(form, b - size, b) ^ np.uint64(0xC13FA9A902A6328F)]
            line += [few, few]
    line, keys = np.concatenate(line), np.concatenate(keys)
    order = np.lexsort((keys, line))
    line, keys = line[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (line[1:] != line[:-1]) | (keys[1:] != keys[:-1])
    return keys[new], np.searchsorted(line[new], np.arange(len(n) + 1))


def _forms(low: np.ndarray, s: np.ndarray, e: np.ndarray, ptr: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normal forms of these lines in one buffer, a blank after each, and where they start."""
    count = np.diff(ptr)[lines]
    words = np.repeat(ptr[lines] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(lines) else np.zeros(0, np.int64)
    s, e = s[words], e[words]
    at = np.concatenate([[0], np.cumsum(e - s + 1)])
    step = np.zeros(len(low) + 1, np.int8)  # words are in the order of the bytes
    step[s] = 1
    step[e] -= 1
    body = np.ones(at[-1], bool)
    body[at[1:] - 1] = False
    out = np.full(at[-1], 32, np.uint8)
    out[body] = low[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    return out, at[np.concatenate([[0], np.cumsum(count)])]


def _form_column(low, s, e, ptr, once: np.ndarray) -> pa.Array:
    """The normal form of each line of ``once``, null for others."""
    form, at = _forms(low, s, e, ptr, np.flatnonzero(once))
    inside = np.ones(len(form), bool)
    inside[at[1:] - 1] = False
    ends = (at - np.arange(len(at))).astype(np.int32)
    forms = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(ends), pa.py_buffer(form[inside]))
    return forms.take(pa.array(np.cumsum(once) - 1, mask=~once))


def _sketches(form: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """lines x bits / 64: of each normal form the parities of its runs of three characters, by class.

    An edit takes three runs and brings three at most, so lines differ in up to FLIPS bits an edit.
    """
    start = np.flatnonzero((form & 0xC0) != 0x80)
    size = np.diff(np.append(start, len(form)))
    code = form[start].astype(np.uint32)
    for k in range(1, 4):
        wide = np.flatnonzero(size > k)
        code[wide] = code[wide] * np.uint32(256) + form[start[wide] + k]
    with np.errstate(over="ignore"):
        kind = ((((code[:-2] * np.uint32(31) + code[1:-1]) * np.uint32(0x85EBCA6B) + code[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(20)) & np.uint32(bits - 1)
    at = np.searchsorted(start, at)
    n = np.maximum(np.diff(at) - 2, 0)  # the blank behind a line is in its last run
    out = np.zeros((len(n), bits // 8), np.uint8)
    for a in range(0, len(n), 512):
        own = n[a : a + 512]
        row = np.repeat(np.arange(len(own)), own)
        place = np.arange(own.sum()) + np.repeat(at[a : a + len(own)] - np.cumsum(own) + own, own)
        odd = np.bincount(row * bits + kind[place], minlength=bits * len(own)).astype(np.uint8) & 1
        out[a : a + 512] = np.packbits(odd.reshape(-1, bits), axis=1)
    return out.view(np.int64)


def _sketch_lists(low, s, e, ptr, chars: np.ndarray, once: np.ndarray) -> pa.Array:
    """A sketch of each line of ``once``, null for others: of PARITY bits, for long lines of four times as many."""
    words = np.where(chars > LONG, 4, 1) * once * (PARITY // 64)
    ends = np.concatenate([[0], np.cumsum(words)])
    flat = np.zeros(ends[-1], np.int64)
    for long, bits in ((False, PARITY), (True, 4 * PARITY)):
        lines = np.flatnonzero(once & ((chars > LONG) == long))
        if len(lines):
            flat[np.repeat(ends[lines], bits // 64) + np.tile(np.arange(bits // 64), len(lines))] = _sketches(*_forms(low, s, e, ptr, lines), bits).ravel()
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat), mask=pa.array(~once))


def _bits_apart(x: str, y: str) -> str:
    """In how many bits two sketches differ. Beside a short one, a long one is folded to its length: its classes are finer."""
    n = PARITY // 64
    whole = " + ".join(f"bit_count({x}[{i}] ^ {y}[{i}])" for i in range(4 * n))
    fold = lambda z, i: f"if(size({z}) = {4 * n}, {' ^ '.join(f'get({z}, {i + n * k})' for k in range(4))}, {z}[{i}])"
    folded = " + ".join(f"bit_count({fold(x, i)} ^ {fold(y, i)})" for i in range(n))
    return f"if(size({x}) = {4 * n} and size({y}) = {4 * n}, {whole}, {folded})"


def _fine_bits(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of 64 bits, pointer of rows into them): of each row the parities of its runs of FINE characters, by classes that grow with its length.

    An edit changes FINE runs of either line at most. Long lines share most short runs and fill
    sketches of few bits, so that nothing tells them apart; they share few of FINE characters.
    """
    if len(buf) and buf.max() < 0x80:
        code, at = buf.astype(np.uint32), off
    else:
        start = np.flatnonzero((buf & 0xC0) != 0x80)
        size = np.diff(np.append(start, len(buf)))
        code, at = buf[start].astype(np.uint32), np.searchsorted(start, off)
        for k in range(1, 4):
            wide = np.flatnonzero(size > k)
            code[wide] = code[wide] * np.uint32(256) + buf[start[wide] + k]
    run = np.zeros(len(code), np.uint32)  # of the run that starts at each character
    with np.errstate(over="ignore"):
        for k in range(min(FINE, len(code))):
            run *= np.uint32(0x9E3779B1)
            run[: len(code) - k] += code[k:]
        run ^= run >> np.uint32(15)
        run *= np.uint32(0x85EBCA6B)
        run >>= np.uint32(32 - FINE_BITS[1])
    run = run.astype(np.int32)
    chars = np.diff(at)
    bits = np.int64(1) << np.clip(np.ceil(np.log2(6 * np.maximum(chars, 1))).astype(np.int64), *FINE_BITS)
    ends = np.concatenate([[0], np.cumsum(bits)])
    out, a = [np.zeros(0, np.int64)], 0
    while a < len(chars):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + (1 << 20), side="right")) - 1)
        kind = run[at[a] : at[b]] & np.repeat((bits[a:b] - 1).astype(np.int32), chars[a:b])
        kind += np.repeat((ends[a:b] - ends[a]).astype(np.int32), chars[a:b])
        last = at[a + 1 : b + 1, None] - np.arange(1, FINE)  # no run starts here
        kind[(last - at[a])[last >= at[a:b, None]]] = ends[b] - ends[a]
        odd = np.bincount(kind, minlength=int(ends[b] - ends[a]) + 1)[:-1].astype(np.uint8)
        out.append(np.packbits(odd & 1).view(np.int64))
        a = b
    return np.concatenate(out), ends // 64


def _fine_sketches(buf: np.ndarray, off: np.ndarray) -> pa.Array:
    """``_fine_bits`` as lists."""
    words, ends = _fine_bits(buf, off)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(words))


class _Fine:
    """Finer sketches of a column of texts, compared many pairs at a time; a text has one when it is first compared."""

    def __init__(self, forms: pa.ChunkedArray):
        self.forms = forms.combine_chunks() if isinstance(forms, pa.ChunkedArray) else forms
        self.size, self.place = np.zeros(len(forms), np.int64), np.zeros(len(forms), np.int64)
        self.of: dict[int, np.ndarray] = {}

    def _sketch(self, texts: np.ndarray) -> None:
        parts = [_fine_bits(buf, off) for _, buf, off in tn.slices(self.forms.take(pa.array(texts)))]
        words = np.concatenate([x for x, _ in parts]).view(np.uint64)  # bits of a negative number are counted otherwise
        size = np.concatenate([np.diff(x) for _, x in parts])
        self.size[texts], start = size, np.cumsum(size) - size
        for n in np.unique(size).tolist():
            own, old = np.flatnonzero(size == n), self.of.get(n, np.zeros((0, n), np.uint64))
            self.place[texts[own]] = len(old) + np.arange(len(own))
            self.of[n] = np.concatenate([old, words[start[own][:, None] + np.arange(n)]])

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many bits each pair differs. Lines are like in length: the longer sketch is folded once."""
        both = np.zeros(len(self.size), bool)
        both[x] = both[y] = True
        if len(new := np.flatnonzero(both & (self.size == 0))):
            self._sketch(new)
        out = np.zeros(len(x), np.int64)
        x, y = np.where(self.size[x] < self.size[y], y, x), np.where(self.size[x] < self.size[y], x, y)
        for n in np.unique(self.size[x]).tolist():
            for m in (n, n // 2):
                both = np.flatnonzero((self.size[x] == n) & (self.size[y] == m))
                for at in range(0, len(both), step := max(1, (1 << 20) // n)):
                    own = both[at : at + step]
                    one, other = self.of[n][self.place[x[own]]], self.of[m][self.place[y[own]]]
                    one = one if m == n else one[:, :m] ^ one[:, m:]
                    out[own] = np.bitwise_count(one ^ other).sum(axis=1, dtype=np.int64)
        return out


def _fine_apart(x: str, y: str) -> str:
    """In how many bits two finer sketches differ, of lines that are like in length: the longer sketch is folded once."""
    fold = lambda x, y: f"aggregate(transform({y}, (v, i) -> bit_count(v ^ {x}[i] ^ {x}[i + size({y})])), 0, (s, v) -> s + v)"
    same = f"aggregate(zip_with({x}, {y}, (v, w) -> bit_count(v ^ w)), 0, (s, v) -> s + v)"
    return f"case when size({x}) = size({y}) then {same} when size({x}) = 2 * size({y}) then {fold(x, y)} when size({y}) = 2 * size({x}) then {fold(y, x)} else 0 end"


def line_blocks(docs: DataFrame, sketched: bool = True, formed: bool = False) -> DataFrame:
    """doc_id, line, node and check (hashes of the normal form), chars, keys and, if wanted, sketch and form of each line with a word.

    Of lines of a batch that are equal only the first has keys, sketch and form.
    """
    names = ["doc_id", "line", "node", "check", "chars", "keys", *(["sketch"] if sketched else []), *(["form"] if formed else [])]

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for first, buf, off in tn.slices(batch.column("text")):
                low, _, rows, number, s, e, ptr = _lines(buf, off)
                has = np.diff(ptr) > 0
                if not has.any():
                    continue
                ptr = np.append(ptr[:-1][has], ptr[-1])
                word = tn.span_hashes(low, s, e)
                node, check = _nodes(word, ptr)
                chars = np.concatenate([[0], np.cumsum((low & 0xC0) != 0x80)])
                chars = np.concatenate([[0], np.cumsum(chars[e] - chars[s] + 1)])
                chars = chars[ptr[1:]] - chars[ptr[:-1]] - 1
                keys, key_ptr = _keys(low, s, e, word, ptr)
                once = np.zeros(len(node), bool)
                once[np.unique(node, return_index=True)[1]] = True
                size = np.diff(key_ptr)
                keys = keys[np.repeat(once, size)]
                ends = np.concatenate([[0], np.cumsum(size * once)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first + rows[has]]), pa.array(number[has].astype(np.int32)), pa.array(node.view(np.int64)), pa.array(check.astype(np.int32)), pa.array(chars.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64)), mask=pa.array(~once)),
                     *([_sketch_lists(low, s, e, ptr, chars, once)] if sketched else []), *([_form_column(low, s, e, ptr, once)] if formed else [])],
                    names=names,
                )

    return docs.mapInArrow(run, "doc_id long, line int, node long, check int, chars int, keys array<long>" + (", sketch array<long>" if sketched else "") + (", form string" if formed else ""))


def _similar(pairs: DataFrame, forms: DataFrame, similarity: float, chars: int = CELL) -> DataFrame:
    """Of pairs (a, b, key, sizes) those whose forms (node, form) are at the similarity.

    A form goes where its pairs are, once for all those of a cell, and not once a pair. A cell holds
    pairs of a key; a key of more than ``chars`` characters of pairs is a square of cells, by hashes of both
    nodes, and a cell that is still too large, as a hub's, is cut by pairs. Small ones share a task.
    """
    total = pairs.agg(F.sum("sizes")).first()[0] or 0
    parts = F.lit(max(1, -(-total // chars)))
    hot = pairs.groupBy("key").agg(F.sum("sizes").alias("_n")).where(F.col("_n") > chars).select("key", F.ceil(F.sqrt(F.col("_n") / chars)).alias("_side"))
    side = F.coalesce("_side", F.lit(1))
    cells = pairs.join(hot, "key", "left").select("a", "b", "sizes", F.xxhash64("key", F.pmod(F.xxhash64("a"), side), F.pmod(F.xxhash64("b"), side)).alias("cell"))
    hot = cells.groupBy("cell").agg(F.sum("sizes").alias("_n")).where(F.col("_n") > 2 * chars).select("cell", F.ceil(F.col("_n") / chars).alias("_cuts"))
    cut = F.when(F.col("_cuts").isNotNull(), F.pmod(F.xxhash64("a", "b"), "_cuts")).otherwise(0)
    cells = materialise(cells.join(hot, "cell", "left").select("a", "b", F.pmod(F.xxhash64("cell", cut), parts).alias("cell")), "cells")
    wanted = marked(cells.select(F.col("cell").alias("at"), F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    ends = wanted.join(forms, "node")

    def run(part: pa.Table, texts: pa.Table) -> pa.Table:
        node, form = texts.column("node").to_numpy(), texts.column("form").to_pylist()
        order = np.argsort(node)
        x, y = (order[np.searchsorted(node, part.column(c).to_numpy(), sorter=order)] for c in "ab")
        size = np.fromiter(map(len, form), np.int64, len(form))
        ok = edits.among(form, x, y, np.floor((1 - similarity + 1e-9) * np.maximum(size[x], size[y])).astype(np.int64))
        return part.select(["a", "b"]).filter(pa.array(ok))

    with bloom_filters(pairs.sparkSession):
        links = materialise(cells.groupBy("cell").cogroup(ends.groupBy("at")).applyInArrow(run, "a long, b long"), "similar")
    drop(cells, wanted)
    return links


def _joins(cell: np.ndarray, component: np.ndarray, size: np.ndarray, side: np.ndarray, node: np.ndarray, form: list[str], fine: _Fine, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of pairs whose links join all components that any link within a cell joins.

    Rows are sorted by cell, node is their place in form. The first members of all cells meet the
    others first, then the second ones and so on, and what is joined by then is not compared again.
    """
    start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    count = np.diff(np.append(start, len(cell)))
    rank = np.arange(len(cell)) - np.repeat(start, count)
    behind = np.repeat(count, count) - 1 - rank
    length = np.fromiter(map(len, form), np.int64, len(form))
    _, component = np.unique(component, return_inverse=True)
    top = np.arange(component.max() + 1)  # of each component the one that it is joined to
    out: list[np.ndarray] = []
    low, high = 0, FIRST
    while low <= rank.max():
        rows = np.flatnonzero((rank >= low) & (rank < high) & (behind > 0))
        low, high = high, 2 * high
        while len(rows):
            own = rows[: max(1, int(np.searchsorted(np.cumsum(behind[rows]), PAIRS, side="right")))]
            rows = rows[len(own) :]
            n = behind[own]
            x = np.repeat(own, n)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
            ok = (top[component[x]] != top[component[y]]) & ((side[x] != side[y]) | (side[x] == 0))
            x, y = x[ok], y[ok]
            ok = np.minimum(size[x], size[y]) >= 0.999 * similarity * np.maximum(size[x], size[y])
            x, y = x[ok], y[ok]
            most = np.floor((1 - similarity + 1e-9) * np.maximum(length[node[x]], length[node[y]])).astype(np.int64)
            ok = fine.apart(node[x], node[y]) <= 2 * FINE * most
            x, y, most = x[ok], y[ok], most[ok]
            ok = edits.among(form, node[x], node[y], most, edits.KINDS[:1])  # the sketches are of runs of five
            if not ok.any():
                continue
            for i, j in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                a, b = int(component[i]), int(component[j])
                while top[a] != a:
                    a = int(top[a])
                while top[b] != b:
                    b = int(top[b])
                if a != b:
                    top[max(a, b)] = min(a, b)
                    out.append(np.array([i, j]))
            while (top[top] != top).any():
                top = top[top]
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _open_links(left: DataFrame, forms: DataFrame, similarity: float, members: int = MEMBERS, chars: int = CELL) -> DataFrame:
    """Of members (key, node, component, size) of lists links (a, b, key, size, other_size) that join all components that any link of a list joins.

    A form goes to a cell once, whatever the pairs there. A list is a cell. One of more than ``members`` or of too many
    characters is cut into bands of size, of which neighbours alone meet, and those into parts by hashes of the
    nodes: each pair of parts is a cell, and each pair of members lies in one. Cells share a group up to ``chars``
    characters and GROUP pairs, so that many pairs go through their distances together.
    """
    banded = left.withColumn("band", band_of(0.999 * similarity))
    hot = banded.groupBy("key", "band").agg(F.count("*").alias("n"), F.sum(F.col("size").cast("long")).alias("chars"))
    hot = hot.groupBy("key").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.max(F.greatest(F.ceil(F.col("n") / members), F.ceil(4 * F.col("chars") / chars))).alias("_parts")).where((F.col("n") > members) | (F.col("chars") > chars)).select("key", "_parts")
    whole = "array(named_struct('b', 0L, 'i', 0L, 'j', 0L, 'side', 0))"
    every = "sequence(0L, _parts - 1)"
    first = f"transform({every}, k -> named_struct('b', band, 'i', _own, 'j', k, 'side', if(k = _own, 0, 1)))"
    second = f"transform(filter({every}, k -> k < _own), k -> named_struct('b', band, 'i', k, 'j', _own, 'side', 2))"
    below = f"transform({every}, k -> named_struct('b', band - 1, 'i', k, 'j', _own, 'side', 2))"
    cells = banded.join(hot, "key", "left").withColumn("_own", F.expr("pmod(xxhash64(node), _parts)"))
    cells = cells.select("key", "node", "component", "size", F.explode(F.expr(f"if(_parts is null, {whole}, concat({first}, {second}, {below}))")).alias("_c"))
    cells = materialise(cells.select("key", "node", "component", "size", F.xxhash64("key", "_c.b", "_c.i", "_c.j").alias("cell"), "_c.side"), "cells")
    load = cells.groupBy("cell").agg(F.sum(F.col("size").cast("long")).alias("chars"), F.count("*").alias("n"))
    total, pairs = load.agg(F.sum("chars"), F.sum(F.expr("n * (n - 1) div 2"))).first()
    parts = F.lit(max(1, -(-(total or 0) // chars) + (pairs or 0) // GROUP))
    placed = cells.select("key", "node", "component", "size", "cell", "side", F.pmod(F.xxhash64("cell"), parts).alias("at"))
    ends = placed.select(F.col("at").alias("there"), F.col("node").alias("member")).distinct().join(forms.withColumnRenamed("node", "member"), "member")

    def run(part: pa.Table, texts: pa.Table) -> pa.Table:
        column = lambda t, c: t.column(c).to_numpy()
        order = np.argsort(column(part, "cell"), kind="stable")
        part = part.take(pa.array(order))
        known = column(texts, "member")
        by = np.argsort(known)
        node = by[np.searchsorted(known, column(part, "node"), sorter=by)]
        x, y = _joins(*(column(part, c) for c in ("cell", "component", "size", "side")), node, texts.column("form").to_pylist(), _Fine(texts.column("form")), similarity)
        one, other = part.take(pa.array(x)), part.take(pa.array(y))
        return pa.table({"a": one.column("node"), "b": other.column("node"), "key": one.column("key"), "size": one.column("size"), "other_size": other.column("size")})

    kinds = {f.name: f.dataType.simpleString() for f in left.schema}
    links = materialise(placed.groupBy("at").cogroup(ends.groupBy("there")).applyInArrow(run, f"a long, b long, key long, size {kinds['size']}, other_size {kinds['size']}"), "open-links")
    drop(cells)
    return links


def duplicate_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, lines): the numbers, from 0, of the lines of each document that must go."""
    docs = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    if docs.schema["doc_id"].dataType.typeName() != "long":
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    spark = docs.sparkSession
    full = materialise(line_blocks(docs, sketched=False, formed=True), "full-lines")
    lines = materialise(full.select("doc_id", "line", "node", "check"), "lines")
    least = F.min(F.struct("doc_id", "line", "check"))
    whole = full.groupBy("node").agg(least.alias("first"), F.first("chars").alias("chars"), F.first("keys", ignorenulls=True).alias("keys"), F.count("*").alias("n"))
    whole = materialise(whole.select("node", "first.doc_id", "first.line", "first.check", F.col("chars").alias("size"), "keys", "n"), "full-nodes")
    free(spark)
    posts = whole.select(F.explode("keys").alias("key"), "node", F.col("n").alias("pri"), "size")
    # most keys have one post, and those are told by the keys alone
    shared = marked(posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    with bloom_filters(spark):
        posts = materialise(posts.join(shared.hint("merge"), "key"), "posts")
    nodes = materialise(whole.drop("keys", "size"), "nodes")
    drop(shared, whole)
    free(spark)
    # normal forms of what can have a link, a node once: where they are is where the lines are, so that texts are read once
    ids = marked(posts.select("node").distinct(), "ids")
    with bloom_filters(spark):
        forms = materialise(full.where("form is not null").select("node", "form").join(ids.hint("merge"), "node").dropDuplicates(["node"]), "forms")
    drop(ids, full)
    free(spark)
    found = link(posts, lambda pairs: _similar(pairs, forms, similarity), similarity, hubs=1, keyed=True, rest=lambda left: _open_links(left, forms, similarity))
    drop(forms)
    # only lines of several places, and those with links, have groups of more than one
    with bloom_filters(docs.sparkSession):
        linked = materialise(nodes.join(marked(found, "found").hint("merge"), "node"), "linked")
    alone = nodes.where("n > 1").join(linked.select("node"), "node", "left_anti").withColumn("component", F.col("node"))
    of = materialise(linked.unionByName(alone), "of")
    firsts = of.groupBy("component").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.sum("n").alias("n")).where("n > 1").select("component", F.col("first.doc_id").alias("keep_doc"), F.col("first.line").alias("keep_line"))
    groups = marked(of.select("node", "check", "component").join(firsts, "component").select("node", "check", "keep_doc", "keep_line"), "groups")
    # a line that has a node's hash and not its check is another line
    with bloom_filters(docs.sparkSession):
        gone = materialise(lines.select("doc_id", "line", "node", "check").join(groups.hint("merge"), ["node", "check"]).where("doc_id <> keep_doc or line <> keep_line").select("doc_id", "line"), "gone-lines")
    lists = materialise(gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("lines")), "gone")
    drop(lines, nodes, posts, found, linked, of, groups, gone)
    return lists


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with every column as it is, text without its duplicate lines, and two counts.

    n_lines and n_removed are added (before them, columns of these names are dropped). doc_id must
    be an integer. A null text stays null with 0 lines; an empty text has one empty line. Rows
    without doc_id pass unchanged, as do blank lines. Rows that repeat a doc_id are taken as one
    document: lines at the same number fall together. An empty table gives an empty one. Lines may
    be of any length: near ones cost their length and the square of their edits, and most others
    are told apart by counts of character runs.
    """
    docs = docs.drop("n_lines", "n_removed")
    gone = duplicate_lines(docs, similarity).select(F.col("doc_id").alias("_gone_id"), F.col("lines").alias("_gone_lines")).hint("merge")
    out = docs.join(gone, F.col("doc_id") == F.col("_gone_id"), "left")
    kinds = {f.name: f.dataType.simpleString() for f in out.schema}
    columns = docs.columns
    names = [*columns, "n_lines", "n_removed"]
    schema = ", ".join(f"`{c}` {'string' if c == 'text' else kinds[c]}" for c in columns) + ", n_lines int, n_removed int"

    def run(batches):
        for batch in batches:
            texts, counts, removed = [], [], []
            for text, lines in zip(batch.column("text"), batch.column("_gone_lines"), strict=True):
                text, lines = text.as_py(), lines.as_py()
                counts.append(0 if text is None else text.count("\n") + 1)
                removed.append(0 if text is None or lines is None else len(lines))
                if text is not None and lines is not None:
                    parts, lines = text.split("\n"), set(lines)
                    text = "\n".join(x for i, x in enumerate(parts) if i not in lines)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in columns] + [pa.array(counts, pa.int32()), pa.array(removed, pa.int32())], names=names)

    return out.drop("_gone_id").mapInArrow(run, schema)
