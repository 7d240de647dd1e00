"""A bidirectional FM-index over a delimited vocabulary, searched in numpy batches.

The text is ``$w1$w2...$wn`` read as a circle, ``$`` (byte 0) before every word.
Rotations of the text and of its mirror image are sorted; a pattern is an interval
of suffix ranks in both orders, of one size. Putting a symbol before the pattern
moves the first interval by symbol ranks in the last column of the sorted rotations
and the second by the number of lesser symbols there, and the other way round
behind it. Ranks and lesser counts come from wavelet matrices.

All searches of a batch advance together, one symbol a round.
"""

from __future__ import annotations

import numpy as np


def rotation_order(codes: np.ndarray) -> np.ndarray:
    """Start of every rotation of ``codes`` (bytes) in sorted order, by doubling."""
    n = len(codes)
    wide = np.concatenate([codes] * (8 // n + 2))[:n + 8].astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | wide[i:i + n]
    reach = 8
    while True:
        order = np.argsort(key, kind="stable")
        ranks = np.empty(n, np.int64)
        ranks[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if ranks[order[-1]] == n - 1 or reach >= n:
            return order.astype(np.int32)
        key = (ranks * np.int64(n) + np.roll(ranks, -reach)).astype(np.uint64)
        reach *= 2


class _Ranks:
    """Wavelet matrix of the last column: where each symbol's rows lead."""

    def __init__(self, last: np.ndarray, n_symbols: int):
        self.levels = []
        bits = max(1, int(n_symbols - 1).bit_length())
        now = last
        for b in range(bits - 1, -1, -1):
            one = (now >> b & 1).astype(bool)
            zeros = np.concatenate([[0], np.cumsum(~one)]).astype(np.int32)
            self.levels.append((b, zeros, int(zeros[-1])))
            now = np.concatenate([now[~one], now[one]])
        symbols = np.arange(n_symbols)
        self.first = np.searchsorted(np.sort(last), symbols)
        self.leaf = np.zeros(n_symbols, np.int64)
        self.leaf = self._descend(np.zeros(n_symbols, np.int64), np.zeros(n_symbols, np.int64), symbols)[0]

    def _descend(self, lo, hi, symbol):
        lesser = np.zeros(len(lo), np.int64)
        for b, zeros, n_zeros in self.levels:
            zl, zh = zeros[lo], zeros[hi]
            one = (symbol >> b & 1).astype(bool)
            lesser += np.where(one, zh - zl, 0)
            lo = np.where(one, lo - zl + n_zeros, zl)
            hi = np.where(one, hi - zh + n_zeros, zh)
        return lo, hi, lesser

    def step(self, at, size, symbol):
        """(at, size, lesser) after each interval takes one symbol."""
        lo, hi, lesser = self._descend(at, at + size, symbol)
        return self.first[symbol] + lo - self.leaf[symbol], hi - lo, lesser

    def fan(self, at, size):
        """(source, symbol, at, size, lesser) of every symbol that occurs in each interval."""
        source, symbol, lo, hi = np.arange(len(at)), np.zeros(len(at), np.int64), at, at + size
        for b, zeros, n_zeros in self.levels:
            zl, zh = zeros[lo], zeros[hi]
            left, right = zh > zl, hi - zh > lo - zl
            source = np.concatenate([source[left], source[right]])
            symbol = np.concatenate([symbol[left], symbol[right] | 1 << b])
            lo, hi = (np.concatenate([zl[left], (lo - zl + n_zeros)[right]]),
                      np.concatenate([zh[left], (hi - zh + n_zeros)[right]]))
        by = np.argsort(source * np.int64(256) + symbol, kind="stable")
        source, symbol, lo, size = source[by], symbol[by], lo[by], (hi - lo)[by]
        before = np.cumsum(size) - size
        head = np.searchsorted(source, source)
        return source, symbol, self.first[symbol] + lo - self.leaf[symbol], size, before - before[head]


class Vocabulary:
    """Index of distinct words (bytes without 0), not empty."""

    def __init__(self, words: list[bytes]):
        text = np.frombuffer(b"\0" + b"\0".join(words), np.uint8)
        self.size = len(text)
        self.starts = np.flatnonzero(text == 0)
        present = np.unique(text)
        self.code = np.full(256, len(present), np.int64)  # a symbol that the text lacks has no rows
        self.code[present] = np.arange(len(present))
        self.order = rotation_order(text)
        dense = self.code[text]
        self.before = _Ranks(dense[self.order - 1], len(present) + 1)
        mirror = text[::-1]
        self.behind = _Ranks(self.code[mirror][rotation_order(mirror) - 1], len(present) + 1)

    def _flat(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return self.code[np.frombuffer(b"".join(parts), np.uint8)], np.cumsum(sizes) - sizes, sizes

    def exact(self, parts: list[bytes]):
        """(forward, mirrored, size): intervals of the patterns, matched from their ends."""
        flat, start, sizes = self._flat([p[::-1] for p in parts])
        fore, back = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        size = np.full(len(parts), self.size)
        for k in range(int(sizes.max(initial=0))):
            live = np.flatnonzero((sizes > k) & (size > 0))
            to, n, lesser = self.before.step(fore[live], size[live], flat[start[live] + k])
            fore[live], back[live], size[live] = to, back[live] + lesser, n
        return fore, back, size

    def one_error(self, parts: list[bytes], rests: list[bytes], rightwards: bool) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, word) numbers of all words ``part + rest'`` where rest' differs
        from the pattern's ``rest`` by one symbol; leftwards ``rest' + part``.

        ``parts`` hold their outer delimiter; ``rests`` do not.
        """
        fore, back, size = self.exact(parts)
        flat, start, sizes = self._flat([(r if rightwards else r[::-1]) + b"\0" for r in rests])
        end = start + sizes - 1
        ranks = self.behind if rightwards else self.before
        main, other = (back, fore) if rightwards else (fore, back)
        who = np.flatnonzero(size > 0)
        # exact states (who, at, main, other, size) and states that have spent their error
        clean = (who, start[who], main[who], other[who], size[who])
        spent = tuple(np.zeros(0, np.int64) for _ in range(5))
        found = []
        while len(clean[0]) or len(spent[0]):
            who, at, main, other, size = spent
            to, n, lesser = ranks.step(main, size, flat[at])
            live, done = n > 0, at == end[who]
            hit = live & done
            found.append((who[hit], to[hit] if not rightwards else (other + lesser)[hit]))
            live &= ~done
            later = [(who[live], at[live] + 1, to[live], (other + lesser)[live], n[live])]
            who, at, main, other, size = clean
            source, symbol, to, n, lesser = ranks.fan(main, size)
            error = (symbol != 0) & (symbol != flat[at[source]])
            s = source[error]
            grown = (who[s], at[s], to[error], other[s] + lesser[error], n[error])  # one symbol more
            inner = grown[1] < end[grown[0]]
            later += [grown, (grown[0][inner], grown[1][inner] + 1, *(x[inner] for x in grown[2:]))]  # another symbol
            inner = at < end[who]
            later.append((who[inner], at[inner] + 1, main[inner], other[inner], size[inner]))  # one symbol less
            onward = (symbol == flat[at[source]]) & (at[source] < end[who[source]])
            s = source[onward]
            clean = (who[s], at[s] + 1, to[onward], other[s] + lesser[onward], n[onward])
            spent = tuple(map(np.concatenate, zip(*later, strict=True)))
        who, row = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2
        word = np.searchsorted(self.starts, self.order[row])
        pairs = np.unique(who * np.int64(len(self.starts)) + word)
        return pairs // len(self.starts), pairs % len(self.starts)
