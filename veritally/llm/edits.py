"""Bounded edit distance of many pairs of texts at once.

Pairs of a bound below ``COUNTED`` go through the table of distances a column at a time, all of
them together, by the differences of neighbouring cells, 64 to a word (Myers 1999, Hyyrö 2003):
only diagonals that so many edits can use are held, and a pair ends when its last diagonal is over
the bound, so unlike pairs end early. Of pairs of larger bounds the furthest-reaching points move
one edit at a time: on each diagonal the place in the first text that so many edits can reach, then
along equal characters, several of them a comparison. A pair ends where its last diagonal is
through, so near pairs cost about their length and the square of their edits, whatever the bound is.
Those that need more than ``NEAR`` edits go through the table like the others, and so do pairs of too few of a
kind, each alone, with a column's differences in one large integer.
"""

from __future__ import annotations

import numpy as np

#: Diagonals, or characters of the first texts, that are worked on at a time.
CELLS = 1 << 20
#: Columns between looks at which pairs are over their bound, and bits of matches that are set at a time.
COLUMNS, MATCHES = 16, 1 << 22
#: From this bound on, pairs whose runs of so many characters differ too much are told apart first.
COUNTED, RUNS = 300, (5, 7, 9)
#: Edits up to which pairs of such bounds are followed by points, pairs that are worth a step together, and columns and bytes of rows of an integer.
NEAR, TOGETHER, BLOCK, ROWS = 96, 40, 1 << 12, 1 << 26
#: Below it, runs of so many characters are counted by 2^n classes.
KINDS = ((2, 8), (5, 12))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts in one row (16 bits each if all fit), a gap after each, and starts."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer("".join(x + "\0\0\0\0" for x in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.concatenate([[0], np.cumsum(lens + 4)])
    return (raw.astype("<u2") if not len(raw) or raw.max() < 1 << 16 else raw), starts


def _equal_run(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many characters from a[i] and b[j] are equal, up to most."""
    per = 8 // a.itemsize
    wide = [np.ndarray((max(len(x) - per + 1, 0),), "<u8", x.data, 0, (x.itemsize,)) for x in (a, b)]
    out = np.zeros(len(i), np.int64)
    at = np.flatnonzero(most > 0)
    while len(at):
        if len(at) <= 16 and (most[at] - out[at]).max() > 512:  # a few long runs: by slices that grow
            for p in at.tolist():
                size, left = 256, int(most[p])
                while out[p] < left:
                    x, y, part = i[p] + out[p], j[p] + out[p], min(size, left - int(out[p]))
                    differ = a[x : x + part] != b[y : y + part]
                    if differ.any():
                        out[p] += int(differ.argmax())
                        break
                    out[p], size = out[p] + part, min(2 * size, 1 << 16)
            break
        differ = wide[0][i[at] + out[at]] ^ wide[1][j[at] + out[at]]
        step = np.full(len(at), per)
        for k in range(per - 1, -1, -1):
            step[(differ >> np.uint64(64 // per * k)) & np.uint64((1 << 64 // per) - 1) != 0] = k
        out[at] += step
        at = at[(step == per) & (out[at] < most[at])]
    return np.minimum(out, most)


def _grams(code: np.ndarray, size: int) -> np.ndarray:
    h = np.zeros(max(len(code) - size + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + code[k : k + len(h)].astype(np.uint64)
        return np.sort(h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(20))


def _counts(code: np.ndarray, at: np.ndarray, n: np.ndarray, run: int, kinds: int) -> np.ndarray:
    """texts x 2^kinds: how many runs of ``run`` characters fall in each class, 255 at most."""
    h = np.zeros(max(len(code) - run + 1, 0), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(run):
            h = h * np.uint32(0x01000193) + code[k : k + len(h)]
        kind = h * np.uint32(0x9E3779B1) >> np.uint32(32 - kinds)
    n = np.maximum(n - run + 1, 0)
    out = np.zeros((len(n), 1 << kinds), np.uint8)
    for i in range(0, len(n), 256):
        own = n[i : i + 256]
        place = np.arange(own.sum()) + np.repeat(at[i : i + 256] - np.cumsum(own) + own, own)
        row = np.repeat(np.arange(len(own)) << kinds, own)
        out[i : i + 256] = np.minimum(np.bincount(row + kind[place], minlength=len(own) << kinds), 255).reshape(-1, 1 << kinds)
    return out


def _apart(x: np.ndarray, y: np.ndarray) -> int:
    """Runs of characters (sorted hashes) that one has and the other lacks, counted with repeats."""
    both, count = np.unique(x, return_counts=True)
    at = np.searchsorted(y, both)
    met = np.minimum(count, np.searchsorted(y, both, "right") - at).sum()
    return len(x) + len(y) - 2 * int(met)


def within(first: list[str], second: list[str], most: np.ndarray) -> np.ndarray:
    """For each pair of texts whether ``most`` edits (insert, delete, replace a character) suffice."""
    return among([*first, *second], np.arange(len(first)), np.arange(len(first)) + len(first), most)


def among(texts: list[str], x: np.ndarray, y: np.ndarray, most: np.ndarray, kinds: tuple[tuple[int, int], ...] = KINDS) -> np.ndarray:
    """For each pair (x, y) of places in texts whether ``most`` edits suffice. What is counted of a text is counted once for all its pairs.

    kinds: runs that are counted first, as in ``KINDS``; pairs that are told apart by such runs already need fewer.
    """
    most = np.asarray(most, np.int64)
    out = np.zeros(len(x), bool)
    if 2 * len(x) < len(texts):  # only what the pairs need
        used, place = np.unique(np.concatenate([x, y]), return_inverse=True)
        texts, x, y = [texts[k] for k in used.tolist()], place[: len(x)], place[len(x) :]
    a, at = _codes(texts)
    size = np.diff(at) - 4
    n, m, at_a, at_b = size[x], size[y], at[x], at[y]
    todo = np.abs(m - n) <= most
    for p in np.flatnonzero(todo & (most >= COUNTED)):  # an edit changes ``size`` runs of each text at most
        one, other = a[at_a[p] : at_a[p] + n[p]], a[at_b[p] : at_b[p] + m[p]]
        todo[p] = all(_apart(_grams(one, k), _grams(other, k)) <= 2 * k * most[p] for k in RUNS)
    for run, bits in kinds:  # an edit changes ``run`` runs of each text at most; unlike texts share common short runs, but few long ones
        some = np.flatnonzero(todo & (most >= 4) & (most < COUNTED))
        for i in range(0, len(some), 1 << 13):
            own = some[i : i + (1 << 13)]
            used = np.unique(np.concatenate([x[own], y[own]]))
            count = _counts(a, at[used], size[used], run, bits)
            for k in range(0, len(own), 512):
                part = own[k : k + 512]
                one, other = count[np.searchsorted(used, x[part])], count[np.searchsorted(used, y[part])]
                todo[part] = (np.maximum(one, other) - np.minimum(one, other)).sum(axis=1, dtype=np.int64) <= 2 * run * most[part]
    low = np.flatnonzero(todo & (most < COUNTED))
    if len(low):
        kinds = np.unique(a)
        code = np.searchsorted(kinds, a) + 2 if len(kinds) > 250 else (np.cumsum(np.bincount(kinds, minlength=int(kinds[-1]) + 1)) + 1).astype(np.uint8)[a]
        code = code.astype(np.uint8 if len(kinds) <= 250 else np.uint32)
        words = most[low] // 64 + 1
        low, words = (z[np.lexsort((-m[low], words))] for z in (low, words))
        while len(low):
            n_own = max(1, min(int(np.searchsorted(words, words[0], side="right")), CELLS // int(m[low[0]] + 64 * words[0])))
            own = low[:n_own]
            out[own] = _banded(code, at_a[own], at_b[own], n[own], m[own], most[own], int(words[0])) if n_own >= TOGETHER else _alone(a, at_a[own], at_b[own], n[own], m[own], most[own])
            low, words = low[n_own:], words[n_own:]
    order = np.flatnonzero(todo & (most >= COUNTED))
    order = order[np.argsort(most[order], kind="stable")]
    far = [order[:0]]
    while len(order):
        width = np.minimum(most[order], NEAR) + 3
        own = order[: max(1, int(np.searchsorted(np.maximum.accumulate(width) * np.arange(1, len(order) + 1), CELLS)))]
        order = order[len(own) :]
        out[own], more = _points(a, a, at_a[own], at_b[own], n[own], m[own], most[own], NEAR)
        far.append(own[more])
    far = np.concatenate(far)
    out[far] = _alone(a, at_a[far], at_b[far], n[far], m[far], most[far])
    return out


def _alone(code, at_a, at_b, n, m, most) -> np.ndarray:
    """``_banded`` for one pair after the other, of any bound: a column's bits are one integer, which carries by itself."""
    found, rows, of, kinds = np.zeros(len(n), bool), {}, -1, 0
    for p in np.argsort(at_a, kind="stable").tolist():
        a, b, k = int(at_a[p]), int(at_b[p]), int(most[p])
        columns, end = int(m[p]), int(m[p] - n[p])
        if abs(end) > k:
            continue
        spare = (k - abs(end)) // 2
        high = max(end, 0) + spare
        if of != a:  # bits of the first text's places, by character
            text, of = code[a : a + int(n[p])], a
            kinds = np.unique(text)
            rows = {}
        if len(kinds) * len(text) > 8 * ROWS:  # too large for that
            one = slice(p, p + 1)
            found[p] = _reach(code, code, at_a[one], at_b[one], n[one], m[one], most[one])[0]
            continue
        rows = rows or {c: int.from_bytes(np.packbits(text == c, bitorder="little").tobytes(), "little") for c in kinds.tolist()}
        span, last = k + 1, high - end
        mask, part = (1 << span) - 1, (1 << span + BLOCK) - 1
        plus, minus, met, limit = mask >> high << high, 0, 0, k - max(-end, 0)  # in time while j - met <= limit
        for j in range(0, columns, BLOCK):
            own = {c: ((x << high - j) if j < high else (x >> j - high)) & part for c, x in rows.items()}
            for i, c in enumerate(code[b + j : b + min(j + BLOCK, columns)].tolist()):
                x = own.get(c, 0) >> i & mask
                same = ((x & plus) + plus ^ plus | x | minus) & mask
                met += same >> last & 1
                left = same & plus
                right = minus | mask ^ (same | plus)
                same >>= 1
                minus = same & right
                plus = left | mask ^ (same | right)
                if not i & 63 and j + i + 1 - met > limit:
                    break
            else:
                continue
            break
        else:
            found[p] = columns - met <= limit
    return found


def _banded(code, at_a, at_b, n, m, most, words) -> np.ndarray:
    """``within`` for pairs of a bound below 64 * words, in descending order of m; codes are from 2 on.

    At column j bit t stands for row j - high + t of the table of distances, so that a bit stays on
    its diagonal. Rows up to 0 hold j: they match nothing and differ from no neighbour above. The
    distance on the last diagonal never falls, and is followed alone.
    """
    end = m - n
    spare = (most - np.abs(end)) // 2  # how far from the last diagonal, or from the first, a way can stray
    high = np.maximum(end, 0) + spare
    span, columns = 64 * words, int(m[0])
    matches = _matches(code, at_a, at_b, n, m, high, words)
    one, bit = np.uint64(1), np.arange(span)[:, None]
    # at column 0, in the places of column 1: rows from 1 on are one more than the row above
    plus = np.packbits(bit >= high, axis=0, bitorder="little").T.copy().view("<u8").T.copy()
    minus = np.zeros_like(plus)
    word, shift = (high - end) // 64, ((high - end) % 64).astype(np.uint64)
    score, met = np.maximum(-end, 0), np.zeros(len(n), np.uint64)  # the distance is score + j - met
    pair, found, j = np.arange(len(n)), np.zeros(len(n), bool), 0
    with np.errstate(over="ignore"):
        while len(pair):
            step = min(COLUMNS, max(1, MATCHES // (span * len(pair))), columns - j)
            match = matches(pair, j, step)
            for k, size in enumerate(np.searchsorted(-m, -np.arange(j, j + step)).tolist()):  # pairs that have this column
                p, q, x = plus[:, :size], minus[:, :size], match[k, :, :size]
                same = x & p
                same += p
                for w in range(1, words):  # what the sum carries over
                    carry = same[w - 1] < p[w - 1] if w == 1 else (same[w - 1] < p[w - 1]) | (carry & (same[w - 1] == p[w - 1]))
                    same[w] += carry
                same ^= p
                same |= x
                same |= q
                on = same[0] if words == 1 else same[word[:size], np.arange(size)]
                met[:size] += (on >> shift[:size]) & one
                right, left = ~(same | p), same & p
                right |= q
                first = same[1:] << np.uint64(63) if words > 1 else None
                same >>= one
                if words > 1:
                    same[:-1] |= first
                np.bitwise_and(same, right, out=q)
                same |= right
                np.bitwise_or(left, ~same, out=p)
            j += step
            over, near = m <= j, score + np.minimum(m, j) - met.astype(np.int64) <= most
            found[pair[over & near]] = True
            left = ~over & near
            if not left.all():
                pair, m, most, word, shift, score, met, plus, minus = pair[left], m[left], most[left], word[left], shift[left], score[left], met[left], plus[:, left], minus[:, left]
    return found


def _matches(code, at_a, at_b, n, m, high, words):
    """For ``_banded`` a function of pairs, a column j and how many: columns x words x pairs, the bits of rows that match.

    Of each first text, and of each character in use, the places are bits of a table, of which a column is
    cut out by shifts. With too many characters for that, the column's rows are compared one by one.
    """
    span, columns = 64 * words, int(m[0])
    place = np.arange(columns)[None, :]
    others = np.where(place < m[:, None], code[np.minimum(at_b[:, None] + place, len(code) - 1)], code.dtype.type(1))
    if code.itemsize > 1:  # the first texts from bit 0 of column 1 on; 0 and 1 match nothing
        place = np.arange(columns + span)[None, :] - high[:, None]
        rows = np.where((place >= 0) & (place < n[:, None]), code[np.clip(at_a[:, None] + place, 0, len(code) - 1)], code.dtype.type(0))

        def compared(pair, j, step):
            windows = np.lib.stride_tricks.sliding_window_view(rows[pair, j : j + step + span - 1], span, axis=1)
            match = np.packbits(windows == others[pair, j : j + step, None], axis=2, bitorder="little").view("<u8")
            return np.ascontiguousarray(match.transpose(1, 2, 0))

        return compared
    start, first, own = np.unique(at_a, return_index=True, return_inverse=True)
    size = n[first]
    wide = (columns + 2 * span) // 64 + 2  # words of a row: as many bits before a text as diagonals, and behind it
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    used = np.zeros(256, np.int64)
    char = code[np.repeat(start, size) + inside]
    used[np.unique(char)] = 1
    kinds = used.sum()
    used = np.where(used > 0, np.cumsum(used), 0)  # row 0 of a text has no bit
    bit = inside + span
    table = np.zeros(len(start) * (kinds + 1) * wide, np.uint64)
    np.add.at(table, (np.repeat(np.arange(len(start)), size) * (kinds + 1) + used[char]) * wide + bit // 64, np.uint64(1) << (bit % 64).astype(np.uint64))
    row = ((own * (kinds + 1))[:, None] + used[others]) * wide
    row = np.ascontiguousarray(row.T)
    one, most = np.uint64(1), np.uint64(63)

    def cut(pair, j, step):
        at = np.arange(j, j + step)[:, None] + (span - high[pair])[None, :]
        at, shift = row[j : j + step, pair] + (at >> 6), (at & 63).astype(np.uint64)
        out, low = np.empty((step, words, len(pair)), np.uint64), table[at]
        for w in range(words):
            at += 1
            over = table[at]
            out[:, w] = low >> shift | over << one << (most - shift)
            low = over
        return out

    return cut


def _reach(a, b, at_a, at_b, n, m, most) -> np.ndarray:
    """``within`` for pairs of a like bound."""
    return _points(a, b, at_a, at_b, n, m, most, int(most.max()))[0]


def _points(a, b, at_a, at_b, n, m, most, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """``within`` for pairs of a like bound, and which of them ``limit`` edits leave open. Only diagonals that so many
    edits reach, and that can still end in time, are worked on; the first has the column ``zero``."""
    found, more = np.zeros(len(n), bool), np.zeros(len(n), bool)
    pair = np.arange(len(n))
    end, spare = m - n, (most - np.abs(m - n)) // 2  # the last diagonal, and how far from it a way can stray
    low, high = np.minimum(end, 0) - spare, np.maximum(end, 0) + spare
    zero = min(int(max(-low.min(), high.max())), limit) + 1
    far = np.full((len(n), 2 * zero + 1), -(1 << 40))
    far[:, zero] = 0
    for edits in range(min(int(most.max()), limit) + 1):
        x, y = max(1, zero - edits), min(2 * zero, zero + edits + 1)
        k = np.arange(x, y) - zero
        if edits:
            grown = np.maximum(far[:, x:y], far[:, x + 1 : y + 1]) + 1
            np.maximum(grown, far[:, x - 1 : y - 1], out=grown)
            np.minimum(grown, np.minimum(n[pair][:, None], m[pair][:, None] - k), out=grown)
            grown[(k < low[pair][:, None]) | (k > high[pair][:, None]) | (grown < 0) | (grown + k < 0)] = -(1 << 40)
            far[:, x:y] = grown
        row, col = np.nonzero(far[:, x:y] >= 0)
        i, p = far[row, col + x], pair[row]
        j = i + k[col]
        far[row, col + x] = i + _equal_run(a, b, at_a[p] + i, at_b[p] + j, np.minimum(n[p] - i, m[p] - j))
        last = np.clip(end[pair] + zero, 0, 2 * zero)  # the outermost columns are never reached
        ended = far[np.arange(len(pair)), last] >= n[pair]
        found[pair[ended]] = True
        left = ~ended & (most[pair] > edits)
        if not left.all():
            pair, far = pair[left], far[left]
            if not len(pair):
                break
    more[pair] = True
    return found, more
