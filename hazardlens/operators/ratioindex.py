"""A lossless index of earlier texts that may reach a sequence ratio.

What the ratio t leaves unmatched in two texts of n and m characters is at most U = (1 - t)(n + m), and
what is matched, M = t (n + m) / 2, lies in blocks. Between two blocks something is unmatched, so there
are at most U + 1 of them; and every block but one that begins both texts holds a character that is
rare in the earlier text (the sequence matcher leaves frequent ones out of its index from 200
characters on), so there are at most as many as those, and one. A block of L characters holds
L - q + 1 q-grams, so two such texts share at least M - k (q - 1) of them, repeats counted, where k is
the least bound on blocks. The earlier one may therefore leave half as many out of its list, the most
frequent ones, and still shares the other half with all that are like it. Each text is listed by the longest q-grams of which it must share a
good part, so that what texts of one language have in common by chance is what it leaves out.

Lists are held for one block of texts at a time (``Earlier``) and later texts go past them, so no q-gram is
ever shuffled or written. Lists are found by so many bits of a q-gram; where two q-grams have the same, more is
counted than is shared, which loses nothing. What reaches its count is held against the bounds for that very
pair, by letters and by q-grams of several lengths, before its ratio is worked out.
"""

from __future__ import annotations

import difflib
from collections.abc import Sequence
from functools import cache

import numpy as np

#: Characters of a q-gram, longest first; with single characters a text is sure to share most of them at any length.
LEVELS = (12, 8, 3, 2, 1)
#: Part of a text's q-grams that it must share to be listed by them.
SURE = 0.1
#: From this length on the sequence matcher calls a character frequent if it makes up over a hundredth, and one.
LONG, FREQUENT = 200, 100
#: Lengths of q-grams by which a pair is judged before its ratio is worked out.
JUDGED = (2, 3, 4, 5, 6, 8)
#: At most so many bits of a q-gram lead to its list; letters are counted by so many of their last bits.
BITS, LETTER_BITS = 23, 8


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def least_shared(n: int, rare: int, q: int, threshold: float) -> int:
    """How many q-grams an earlier text of ``n`` characters, ``rare`` of them rare, shares at least with one like it.

    The other text has between t / (2 - t) and (2 - t) / t as many characters; the least is at the ends
    or where the two bounds on the number of blocks meet.
    """
    reach = threshold / (2 - threshold)
    low, high = n * (1 + reach), n * (1 + 1 / reach)
    meet = min(max(rare / (1 - threshold), low), high)
    blocks = lambda s: min((1 - threshold) * s, rare) + 1
    return int(np.ceil(min(threshold * s / 2 - blocks(s) * (q - 1) for s in (low, meet, high)) - 1e-9))


def level_of(n: int, rare: int, threshold: float) -> tuple[int, int]:
    """The level of an earlier text and how many q-grams it shares at least."""
    for level, q in enumerate(LEVELS):
        least = least_shared(n, rare, q, threshold)
        if least >= 1 and (least >= SURE * (n - q + 1) or q == 1):
            return level, least
    return len(LEVELS) - 1, 1


def rare_characters(codes: np.ndarray) -> int:
    """How many characters of a text the sequence matcher can begin a block with."""
    if len(codes) < LONG:
        return len(codes)
    times = np.unique(codes, return_counts=True)[1]
    return int(times[times <= len(codes) // FREQUENT + 1].sum())


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """q-grams of a text as 64-bit values, numbered where they repeat."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    h, length, base = codes.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    one = h
    for bit in f"{q:b}"[1:]:  # twice as long, and one longer where the bit says so
        h = h[:-length] * np.uint64(pow(base, length, 1 << 64)) + h[length:]
        length *= 2
        if bit == "1":
            h = h[:-1] * np.uint64(base) + one[length:]
            length += 1
    run = np.sort(_mixed(h))
    again = run[1:] == run[:-1]
    if not again.any():
        return run
    start = np.maximum.accumulate(np.where(np.append(True, ~again), np.arange(len(run)), 0))
    times = (np.arange(len(run)) - start).astype(np.uint64)
    return np.where(times > 0, _mixed(run + times * np.uint64(0xD6E8FEB86659FD93)), run)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _letters(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """How often letters stand in a text, by their last bits: all, those that blocks can begin with, and how many these are."""
    values, times = np.unique(codes, return_counts=True)
    by = lambda v, n: np.bincount(v & ((1 << LETTER_BITS) - 1), n, 1 << LETTER_BITS).astype(np.int32)
    rare = times <= (len(codes) // FREQUENT + 1 if len(codes) >= LONG else len(codes))
    return by(values, times), by(values[rare], times[rare]), int(times[rare].sum())


#: Texts from this length on are matched by arrays, if they have at most so many pairs of equal rare characters.
ARRAYS, PAIRS = 1_500, 4_000_000


def _meetings(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Places in ``a`` and ``b`` of all pairs of equal characters that are rare in ``b``, by diagonal; None if very many."""
    values, at, times = np.unique(b, return_inverse=True, return_counts=True)
    rare = times <= len(b) // FREQUENT + 1
    order = np.argsort(at, kind="stable")
    start = np.cumsum(times) - times
    place = np.minimum(np.searchsorted(values, a), len(values) - 1)
    i = np.flatnonzero((values[place] == a) & rare[place])
    n = times[place[i]]
    if n.sum() > PAIRS:
        return None
    upto = np.cumsum(n)
    j = order[np.arange(n.sum()) + np.repeat(start[place[i]] - (upto - n), n)]
    key = (j - np.repeat(i, n) + len(a)) * (len(a) + 1) + np.repeat(i, n)
    key.sort()
    i = key % (len(a) + 1)
    return i.astype(np.int32), (key // (len(a) + 1) - len(a) + i).astype(np.int32)


def _equal(x: np.ndarray, y: np.ndarray) -> int:
    """How many characters two texts of one length have in common from the beginning."""
    at, size = 0, 64
    while at < len(x):
        other = np.flatnonzero(x[at : at + size] != y[at : at + size])
        if len(other):
            return at + int(other[0])
        at, size = at + size, 4 * size
    return len(x)


def _longest(a: np.ndarray, b: np.ndarray, low: int, high: int, to: int, end: int, i: np.ndarray, j: np.ndarray) -> tuple[int, int, int]:
    """What ``find_longest_match`` finds in a range: the first longest run of pairs, and what is equal around it."""
    x, y, k = low, to, 0
    if len(i):
        begins = np.flatnonzero(np.append(True, (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)))
        runs = np.diff(begins, append=len(i))
        k = int(runs.max())
        first = begins[runs == k]
        first = first[i[first] == i[first].min()]
        x, y = int(i[first[0]]), int(j[first].min())
    back = min(x - low, y - to)
    back = _equal(a[x - back : x][::-1], b[y - back : y][::-1])
    x, y, k = x - back, y - back, k + back
    on = min(high - x, end - y) - k
    return x, y, k + _equal(a[x + k : x + k + on], b[y + k : y + k + on])


def ratio_from(a: str, b: str, least: int) -> float | None:
    """``difflib``'s ratio of two texts, or None once fewer than ``least`` characters can be matched.

    What may still be matched are the ranges left to look at, the shorter side of each.
    """
    x, y = _codes(a), _codes(b)
    met = _meetings(x, y) if min(len(x), len(y)) >= ARRAYS else None
    matcher = None if met else difflib.SequenceMatcher(None, a, b)
    matched, left = 0, min(len(a), len(b))
    ranges = [(0, len(a), 0, len(b), *(met or (None, None)))]
    while ranges:
        low, high, to, end, p, q = ranges.pop()
        left -= min(high - low, end - to)
        i, j, k = matcher.find_longest_match(low, high, to, end) if matcher else _longest(x, y, low, high, to, end, p, q)
        if k:
            matched += k
            for r in ((low, i, to, j), (i + k, high, j + k, end)):
                if r[0] < r[1] and r[2] < r[3]:
                    left += min(r[1] - r[0], r[3] - r[2])
                    inside = None if matcher else (p >= r[0]) & (p < r[1]) & (q >= r[2]) & (q < r[3])
                    ranges.append((*r, *((None, None) if matcher else (p[inside], q[inside]))))
        if matched + left < least:
            return None
    return 2.0 * matched / (len(a) + len(b))


class _Lists:
    """The texts of a block that are found by q-grams of one length."""

    def __init__(self, own: np.ndarray, texts: Sequence[str], least: np.ndarray, q: int):
        self.own, self.q = own, q
        self.left_out = least // 2
        self.asks = least - self.left_out
        lengths = [len(texts[y]) for y in own]
        self.low, self.high = min(lengths), max(lengths)
        self.shift = np.uint64(64 - min(BITS, max(8, sum(lengths).bit_length())))
        held = [self._places(_codes(texts[y])) for y in own]
        size = 1 << (64 - int(self.shift))
        often = np.bincount(np.concatenate(held), minlength=size).astype(np.int32)
        packed = np.empty(sum(len(g) for g in held) - int(np.minimum(self.left_out, [len(g) for g in held]).sum()), np.uint64)
        at = 0
        for k, g in enumerate(held):
            out = min(int(self.left_out[k]), len(g))
            if 0 < out < len(g):
                g = g[np.argpartition(often[g], len(g) - out)[: len(g) - out]]
            elif out:
                g = g[:0]
            packed[at : at + len(g)] = (g.astype(np.uint64) << np.uint64(32)) | np.uint64(k)
            at += len(g)
            held[k] = None
        packed.sort()
        self.at = np.zeros(size + 1, np.int32)
        np.cumsum(np.bincount((packed >> np.uint64(32)).astype(np.int32), minlength=size), out=self.at[1:])
        self.posted = packed.astype(np.uint32).view(np.int32)

    def _places(self, codes: np.ndarray) -> np.ndarray:
        return (grams(codes, self.q) >> self.shift).astype(np.int32)

    def counted(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``own`` of texts that share what they ask for with a text, and how many each shares."""
        g = self._places(codes)
        start = self.at[g]
        n = self.at[g + 1] - start
        start, n = start[n > 0], n[n > 0]
        if not len(n):
            return n, n
        upto = np.cumsum(n)
        shared = np.bincount(self.posted[np.arange(upto[-1]) + np.repeat(start - (upto - n), n)], minlength=len(self.own))
        k = np.flatnonzero(shared >= self.asks)
        return k, shared[k]


class Earlier:
    """A block of texts in the order of their ids, in which the first one is found that a later text is like."""

    def __init__(self, ids: Sequence[int], texts: Sequence[str], threshold: float):
        self.ids, self.texts, self.threshold = np.array(ids, np.int64), texts, threshold
        self.n = np.array([len(t) for t in texts], np.int64)
        self.letters, self.begin = (np.zeros((len(texts), 1 << LETTER_BITS), np.int32) for _ in range(2))
        level, least = (np.zeros(len(texts), np.int64) for _ in range(2))
        for i, t in enumerate(texts):
            self.letters[i], self.begin[i], rare = _letters(_codes(t))
            level[i], least[i] = level_of(len(t), rare, threshold)
        self.lists = []
        for x in np.unique(level):
            own = np.flatnonzero(level == x)
            self.lists.append(_Lists(own, texts, least[own], LEVELS[x]))

    def _left(self, n: int, y: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What must be matched in a text of ``n`` characters and each ``y``, and in how many blocks at most."""
        whole = n + self.n[y]
        least = np.ceil(self.threshold * whole / 2 - 1e-9).astype(np.int64)
        return least, np.minimum(whole - 2 * least, begin) + 1

    def first(self, i: int, text: str) -> tuple[int, float, int] | None:
        """The first text before ``i`` that ``text`` is like: its id, the ratio, and the q-grams that led to it."""
        codes, reach = _codes(text), self.threshold / (2 - self.threshold)
        n, found = len(codes), []
        before = int(np.searchsorted(self.ids, i))
        for held in self.lists if before else ():
            if held.low * reach - 1 <= n <= held.high / reach + 1:
                k, shared = held.counted(codes)
                found.append((held.own[k], shared, held.left_out[k], np.full(len(k), held.q)))
        if not found:
            return None
        ys, shared, left_out, q = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(ys, kind="stable")
        order = order[ys[order] < before]
        mine, of = _letters(codes)[0], cache(lambda q: grams(codes, q))
        at, size = 0, 64
        while at < len(order):  # the first ones first, as one of them may do
            part = order[at : at + size]
            at, size = at + size, min(4 * size, 4096)
            y = ys[part]
            common, begin = (np.minimum(x[y], mine).sum(1) for x in (self.letters, self.begin))
            least, blocks = self._left(n, y, begin)
            likely = (common >= least) & (shared[part] + left_out[part] >= least - blocks * (q[part] - 1))
            for j in np.flatnonzero(likely):
                other = self.texts[y[j]]
                theirs = _codes(other)
                if all(len(np.intersect1d(of(k), grams(theirs, k), assume_unique=True)) >= least[j] - blocks[j] * (k - 1) for k in JUDGED if least[j] > blocks[j] * (k - 1)):
                    ratio = ratio_from(text, other, int(least[j]))
                    if ratio is not None and ratio >= self.threshold:
                        return int(self.ids[y[j]]), ratio, int(shared[part[j]])
        return None
