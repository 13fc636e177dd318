"""A context-mixing range coder of id blocks, many lanes at a time.

A block's ids are cut into equal lanes; step r codes the r-th id of every lane at once, each
lane with its own range coder and all with the block's one model. The model predicts the next
id by order 0 (adaptive frequencies of all ids) and by orders 1 and 2: each context of one id
and (hashed) of two keeps counts of a few ids that followed it. The three distributions
are mixed: the weights of orders 1 and 2 against order 0 are learnt for each pair of their
contexts' experience, and an id that both know has its mass of order 2. The model is brought up
to date after each step, so encoder and decoder see the same one, and it starts anew in each
block. Blocks carry checksums of their bytes and of their ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

_HEAD = struct.Struct("<4sIIIIII")
MAGIC = b"CMR3"
#: SUM_EVERY: ids between sums of the order-0 frequencies.
MOST_LANES, IDS_A_LANE, SUM_EVERY = 8192, 256, 8192
_TOP, _LOW, _SH = np.uint64(1 << 48), np.uint64((1 << 32) - 1), np.uint64(16)
#: Ids that contexts of order 1 and 2 keep; places of contexts of order 2; levels of experience.
_SLOTS1, _SLOTS2, _PLACES, _LEVELS = 4, 4, 1 << 18, 16
_GAIN, _MOST_TOTAL, _MOST_ODDS, _STEP = 24, 1 << 20, 128, 3
#: Experience of a context: its counts' sum, and whether its first slot has most of it.
_level = np.minimum(2 * np.ceil(np.log2(np.arange(1024) + 1)), _LEVELS - 2).astype(np.int32)
_inverse = (1 / np.maximum(np.arange(1024), 1)).astype(np.float32)


class _Context:
    """Slots of the contexts of one order, filled from the first, each id * 256 + count; id -1 is free.

    A context's slots lie side by side, so that looking it up takes one place of memory.
    """

    def __init__(self, contexts: int, slots: int):
        self.table = np.full((contexts, slots), -256, np.int32)
        self.flat = self.table.ravel()

    def look(self, at: np.ndarray) -> np.ndarray:
        """Sets ids and counts of each lane's slots; returns the level of experience."""
        self.at = at.astype(np.intp, copy=False)
        held = np.ascontiguousarray(self.table.take(self.at, axis=0).T)
        self.ids, self.counts = list(held >> 8), list(held & 255)
        self.sum = sum(self.counts[1:], self.counts[0])
        return _level.take(self.sum) + (4 * self.counts[0] > 3 * self.sum)

    def learn(self, ids: np.ndarray, same: list[np.ndarray]) -> None:
        """Counts the id's slot up (same: lanes whose slot it is), past the slot before if it is larger.

        A new id takes the first free slot, or else the last. Of lanes that write one slot the last counts.
        """
        slots = self.table.shape[1]
        slot, new = np.zeros(len(ids), np.int8), np.ones(len(ids), bool)
        for count in self.counts[:-1]:
            slot += count > 0
        for k, own in enumerate(same):
            np.copyto(slot, k, where=own)
            new &= ~own
        place = self.at * slots + slot
        value = np.where(new, ids << 8, self.flat.take(place)) + _STEP
        self.flat[place] = value
        up = np.flatnonzero(slot)
        before, value_up = place.take(up) - 1, value.take(up)
        other = self.flat.take(before)
        swap = np.flatnonzero((value_up & 255) > (other & 255))
        before = before.take(swap)
        self.flat[before + 1] = other.take(swap)
        self.flat[before] = value_up.take(swap)
        full = self.at.take(np.flatnonzero((value & 255) > 250))
        if len(full):
            x = self.table[full]
            self.table[full] = x - ((x & 255) >> 1)


class _Model:
    def __init__(self, vocab: int):
        self.freq = np.ones(vocab, np.int32)
        self.one, self.two = _Context(vocab, _SLOTS1), _Context(_PLACES, _SLOTS2)
        kinds = _LEVELS * _LEVELS
        self.hit1, self.hit2, self.miss = np.ones(kinds, np.int64), np.ones(kinds, np.int64), np.full(kinds, 2, np.int64)
        self._sum()

    def _sum(self) -> None:
        self.cum = np.zeros(len(self.freq) + 1, np.int32)
        np.cumsum(self.freq, out=self.cum[1:])
        self.seen = []

    def predict(self, prev1: np.ndarray, prev2: np.ndarray) -> None:
        """Sets each lane's known ids, the ends of their intervals, and the total.

        Ids known to order 2, then those of order 1 that it doesn't know come first, the order-0 ones after them all.
        """
        self.mix = self.two.look((prev2 * 40503 + prev1 * 2654435) & (_PLACES - 1)) * _LEVELS + self.one.look(prev1)
        total = int(self.cum[-1])
        self.ids, self.mass, self.ends = [*self.two.ids, *self.one.ids], [], []
        for order, hit in ((self.two, self.hit2), (self.one, self.hit1)):
            odds = (8 * total * np.minimum(hit / self.miss, _MOST_ODDS)).astype(np.float32)
            each = (odds.take(self.mix) * _inverse.take(order.sum)).astype(np.int32)  # 8 times a count's mass
            self.mass += [each * c >> 3 for c in order.counts]
        for known, mass in zip(self.one.ids, self.mass[_SLOTS2:], strict=True):
            both = known == self.two.ids[0]
            for x in self.two.ids[1:]:
                both |= known == x
            np.copyto(mass, 0, where=both)
        end = 0
        for m in self.mass:
            end = end + m
            self.ends.append(end)
        self.total = end + np.int32(total)

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of each id."""
        width, start = self.freq.take(ids), self.cum.take(ids) + self.ends[-1]
        self.order = np.zeros(len(ids), np.int32)  # which order knew it
        self.same = [known == ids for known in self.ids]
        for k, (same, mass, end) in enumerate(zip(self.same, self.mass, self.ends, strict=True)):
            at = np.flatnonzero(same & (mass > 0))
            own = mass.take(at)
            width[at] = own
            start[at] = end.take(at) - own
            self.order[at] = 2 if k < _SLOTS2 else 1
        return start.astype(np.uint64), width.astype(np.uint64)

    def find(self, value: np.ndarray) -> np.ndarray:
        """The id whose interval holds the value."""
        ids = self.ids[-1]
        for known, end in zip(self.ids[-2::-1], self.ends[-2::-1], strict=True):
            ids = np.where(value < end, known, ids)
        rest = np.flatnonzero(value >= self.ends[-1])
        ids[rest] = np.searchsorted(self.cum, value.take(rest) - self.ends[-1].take(rest), side="right") - 1
        return ids

    def learn(self, ids: np.ndarray, every: int, step: int) -> None:
        kinds = len(self.miss)
        met = np.bincount(self.order * kinds + self.mix, minlength=3 * kinds).reshape(3, kinds)
        for c, more in zip((self.miss, self.hit1, self.hit2), met, strict=True):
            c += more
        big = self.hit1 + self.hit2 + self.miss > 1 << 14
        if big.any():
            for c in (self.hit1, self.hit2, self.miss):
                c[big] = (c[big] + 1) >> 1
        self.two.learn(ids, self.same[:_SLOTS2])
        self.one.learn(ids, self.same[_SLOTS2:])
        self.seen.append(ids)
        if (step + 1) % every == 0:
            self.freq += (_GAIN * np.bincount(np.concatenate(self.seen), minlength=len(self.freq))).astype(np.int32)
            while self.freq.sum() > _MOST_TOTAL:
                self.freq = (self.freq + 1) >> 1
            self._sum()


def _layout(n: int) -> tuple[int, int, int]:
    """Lanes, ids a lane, and steps between sums of the frequencies."""
    lanes = max(1, min(MOST_LANES, n // IDS_A_LANE))
    return lanes, -(-n // lanes), max(1, SUM_EVERY // lanes)


def _settled(low: np.ndarray, rng: np.ndarray) -> np.ndarray:
    """Lanes that must shift out 16 bits: those are settled, or the range is small."""
    return np.flatnonzero(((low ^ (low + rng)) < _TOP) | (rng <= _LOW))


def _shifted(low: np.ndarray, rng: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both after the shift; a small range is cut where a carry could stay open."""
    cut = ((low ^ (low + rng)) >= _TOP) & (rng <= _LOW)
    return low << _SH, np.where(cut, (~low + np.uint64(1)) & _LOW, rng) << _SH


def encode(ids: np.ndarray, vocab: int) -> bytes:
    """One block. ids below vocab; none is an empty block."""
    ids = np.ascontiguousarray(ids, np.int64)
    n = len(ids)
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    if not n:
        return _HEAD.pack(MAGIC, 0, 0, vocab, crc, 0, zlib.crc32(b""))
    lanes, steps, every = _layout(n)
    lanes = -(-n // steps)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    active = np.full(steps, lanes)
    active[n - (lanes - 1) * steps :] = lanes - 1  # only the last lane can be short
    model = _Model(vocab)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, np.iinfo(np.uint64).max, np.uint64)
    out, used = np.zeros((lanes, 2 * steps + 16), np.uint16), np.zeros(lanes, np.int64)
    row = np.arange(lanes)
    prev1, prev2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    with np.errstate(over="ignore"):
        for r in range(steps):
            k = active[r]
            if not k:
                break
            own = grid[r, :k]
            model.predict(prev1[:k], prev2[:k])
            start, width = model.interval(own)
            unit = rng[:k] // model.total.astype(np.uint64)
            low[:k] += start * unit
            rng[:k] = width * unit
            model.learn(own, every, r)
            prev2[:k], prev1[:k] = prev1[:k], own
            move = _settled(low[:k], rng[:k])
            while len(move):
                x, y, to = low.take(move), rng.take(move), used.take(move)
                if to.max() + 5 > out.shape[1]:
                    out = np.concatenate([out, np.zeros_like(out)], axis=1)
                out.ravel()[move * out.shape[1] + to] = x >> np.uint64(48)
                used[move] = to + 1
                x, y = _shifted(x, y)
                low[move], rng[move] = x, y
                move = move.take(_settled(x, y))
    if used.max() + 4 > out.shape[1]:
        out = np.concatenate([out, np.zeros((lanes, 4), np.uint16)], axis=1)
    for i in range(4):
        out[row, used + i] = (low >> np.uint64(48 - 16 * i)).astype(np.uint16)
    used += 4
    body = used.astype("<u4").tobytes() + out[np.arange(out.shape[1]) < used[:, None]].astype("<u2").tobytes()
    return _HEAD.pack(MAGIC, n, lanes, vocab, crc, len(body), zlib.crc32(body)) + body


def decode(block: bytes) -> np.ndarray:
    """The ids of a block as uint32; ValueError if it is damaged."""
    magic, n, lanes, vocab, crc, size, body_crc = _HEAD.unpack_from(block)
    body = block[_HEAD.size : _HEAD.size + size]
    if magic != MAGIC or len(body) != size or zlib.crc32(body) != body_crc:
        raise ValueError("damaged block")
    if not n:
        return np.zeros(0, np.uint32)
    _, steps, every = _layout(n)
    used = np.frombuffer(body, "<u4", lanes).astype(np.int64)
    words = np.concatenate([np.frombuffer(body, "<u2", offset=4 * lanes), np.zeros(4, np.uint16)]).astype(np.uint64)
    at = np.cumsum(used) - used
    code = np.zeros(lanes, np.uint64)
    for i in range(4):
        code = code << _SH | words[at + i]
    at += 4
    active = np.full(steps, lanes)
    active[n - (lanes - 1) * steps :] = lanes - 1
    model = _Model(vocab)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, np.iinfo(np.uint64).max, np.uint64)
    grid = np.zeros((steps, lanes), np.int32)
    prev1, prev2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    with np.errstate(over="ignore"):
        for r in range(steps):
            k = active[r]
            if not k:
                break
            model.predict(prev1[:k], prev2[:k])
            unit = rng[:k] // model.total.astype(np.uint64)
            own = model.find(np.minimum((code[:k] - low[:k]) // unit, (model.total - 1).astype(np.uint64)).astype(np.int32))
            start, width = model.interval(own)
            low[:k] += start * unit
            rng[:k] = width * unit
            grid[r, :k] = own
            model.learn(own, every, r)
            prev2[:k], prev1[:k] = prev1[:k], own
            move = _settled(low[:k], rng[:k])
            while len(move):
                x, y, to = low.take(move), rng.take(move), at.take(move)
                code[move] = code.take(move) << _SH | words.take(to)
                at[move] = np.minimum(to + 1, len(words) - 1)
                x, y = _shifted(x, y)
                low[move], rng[move] = x, y
                move = move.take(_settled(x, y))
    ids = np.ascontiguousarray(grid.T).ravel()[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("ids differ from what was written")
    return ids
