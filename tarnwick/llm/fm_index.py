"""A compressed FM-index over integer sequences: wavelet matrix, vectorised backward search."""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)
#: Suffixes of one run, whose least owner is kept.
RUN = 32
NOBODY = np.iinfo(np.int32).max


class Bits:
    """A bit vector packed in 64-bit words with a running count before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)])
        self.words = packed.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits among the first i."""
        w = i >> 6
        mask = (ONE << (i & 63).astype(np.uint64)) - ONE
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class WaveletMatrix:
    """rank of a symbol among the first i of a sequence, for many (symbol, i) at once."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in reversed(range(max(1, int(size - 1).bit_length()))):
            bit = (symbols >> shift) & 1
            self.levels.append((shift, Bits(bit.astype(np.uint8)), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.base = self._walk(np.arange(size), np.zeros(size, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.ones(i)
            i = np.where((c >> shift) & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._walk(c, i) - self.base[c]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling; rounds grow with the logarithm of the longest repeat."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        key = rank * (n + 1)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        got = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(got[1:] != got[:-1])])
        k *= 2
        if rank[order[-1]] == n - 1 or k >= n:
            return order


class FMIndex:
    """Index of sequences of 64-bit symbols, each with an owner (smaller is earlier)."""

    def __init__(self, parts: list[np.ndarray], owners: np.ndarray):
        m = len(parts)
        sizes = np.array([len(p) for p in parts])
        self.alphabet, flat = np.unique(np.concatenate(parts), return_inverse=True)
        ends = np.cumsum(sizes + 1) - 1
        text = np.empty(int(ends[-1]) + 1, np.int64)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = flat + m  # words stand above the separators, of which each is different
        text[ends] = np.arange(m)
        order = suffix_array(text)
        last = text[order - 1]
        self.symbols = flat + 1
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.matrix = WaveletMatrix(np.where(last < m, 0, last - m + 1), len(self.alphabet) + 1)
        self.first = np.concatenate([[0, m], m + np.cumsum(np.bincount(flat, minlength=len(self.alphabet)))])
        owner = np.searchsorted(ends, order).astype(np.int64)
        self.owner = np.full(-(-len(order) // RUN) * RUN, NOBODY, np.int32)
        self.owner[: len(order)] = owners[owner]
        self.least = [self.owner.reshape(-1, RUN).min(axis=1)]
        while 2 << (len(self.least) - 1) <= len(self.least[0]):
            step, x = 1 << (len(self.least) - 1), self.least[-1]
            self.least.append(np.minimum(x[:-step], x[step:]))

    def earliest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least owner among the suffixes lo..hi-1 (lo < hi): its first and last run looked through, the runs between by table."""
        out = self.owner[lo].astype(np.int64)
        wide = np.flatnonzero(hi - lo > 1)  # most ranges soon hold one suffix
        out[wide] = self._earliest_of_several(lo[wide], hi[wide])
        return out

    def _earliest_of_several(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        a, b = lo // RUN, (hi - 1) // RUN
        out = np.minimum(self._in_run(a, lo, hi), self._in_run(b, lo, hi))
        between = b - a - 1
        level = np.frexp(np.maximum(between, 0).astype(np.float64))[1] - 1
        for k in np.unique(level[between > 0]):
            at = level == k
            x = self.least[k]
            out[at] = np.minimum(out[at], np.minimum(x[a[at] + 1], x[b[at] - (1 << int(k))]))
        return out

    def _in_run(self, run: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        at = run[:, None] * RUN + np.arange(RUN)
        return np.where((at >= lo[:, None]) & (at < hi[:, None]), self.owner[at], NOBODY).min(axis=1)

    def extend_back(self, start: np.ndarray, end: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """For each stretch start..end-1 of the indexed symbols (without separators), read from its end: where its
        longest ending that an owner below limit has begins (start if the whole stretch is matched)."""
        at = end.copy()
        live = np.arange(len(start))
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), self.first[-1], np.int64)
        while len(live):
            c = self.symbols[at[live] - 1]
            a = self.first[c] + self.matrix.rank(c, lo[live])
            b = self.first[c] + self.matrix.rank(c, hi[live])
            found = b > a
            found[found] = self.earliest(a[found], b[found]) < limit[live[found]]
            live, a, b = live[found], a[found], b[found]
            at[live] -= 1
            lo[live], hi[live] = a, b
            live = live[at[live] > start[live]]
        return at


def matched(parts: list[np.ndarray], owners: np.ndarray, window: int, asked: np.ndarray, limits: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each asked part (its number) the intervals covered by windows that an owner below its limit has, as
    (from, to), merged. A part may be asked for several times, with different limits.

    A stretch of window + g symbols from s on is read backwards. If all of it is matched, so are g + 1 windows, and
    the stretch grows; if not, it shrinks, and at g = 0 no window can hold the symbol where the match broke off.
    What is asked on behalf of later owners is in the index as a whole, so that stretch is tried first.
    """
    index = FMIndex(parts, owners)
    last = np.array([len(p) for p in parts])[asked] - window
    starts = index.starts[asked]
    s = np.zeros(len(asked), np.int64)
    g = np.where(limits > owners[asked], np.maximum(last, 0), 0)
    out: list[list[tuple[int, int]]] = [[] for _ in asked]
    live = np.flatnonzero(last >= 0)
    while len(live):
        base = starts[live]
        g[live] = np.minimum(g[live], last[live] - s[live])
        begin, end = base + s[live], base + s[live] + window + g[live]
        at = index.extend_back(begin, end, limits[live])
        whole = at == begin
        for i, a, b in zip(live[whole].tolist(), s[live[whole]].tolist(), (end - base)[whole].tolist(), strict=True):
            if out[i] and out[i][-1][1] >= a:
                out[i][-1] = (out[i][-1][0], b)
            else:
                out[i].append((a, b))
        ok, no = live[whole], live[~whole]
        s[ok] += g[ok] + 1
        g[ok] = np.maximum(2 * g[ok], 7)
        short = g[no] == 0
        s[no[short]] = (at - base)[~whole][short]
        g[no] //= 2
        live = live[s[live] <= last[live]]
    return out
