"""The matches of many literals (P4) in Arrow arrays of texts, found in their UTF-8 bytes by numpy.

A text's places are narrowed by the first three bytes of the literals, then by four, five and so on
up to eight, so the work follows the bytes and the places where a literal has begun, not texts
times literals. Of the literals that stand at one place only the shortest can be a match: it ends
first, and if it is passed over because a match covers its place, so are the longer ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Places looked at in one go.
PLACES = 1 << 17
#: Bytes of a word: literals up to this size are compared as numbers.
WORD = 8

_HEADS = [np.uint64((1 << 8 * n) - 1) for n in range(WORD + 1)]


def _bytes(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of the texts, WORD more behind them, and the bounds of each text."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = data.slice(bounds[0], bounds[-1] - bounds[0]).to_pybytes() if data else b""
    return raw + bytes(WORD), bounds - bounds[0]


def _at_each_byte(raw: bytes, kind: str) -> np.ndarray:
    """The little-endian number that begins at each byte but the last WORD (a view)."""
    return np.ndarray((len(raw) - WORD,), kind, raw, strides=(1,))


def _mixed(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    x = (a ^ b) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _steps(n: int, most: int) -> list[int]:
    """Where words of ``n`` bytes begin that cover them, or ``most`` of them with the first and the last."""
    return [*range(0, n - WORD, max(WORD, (n - WORD) // most)), n - WORD]


def _hashes(words: np.ndarray, at: np.ndarray, n: int, most: int) -> np.ndarray:
    """Hashes of the ``n`` bytes (WORD or more) from each place, by some of their words."""
    x = np.full(at.size, n, np.uint64)
    for k in _steps(n, most):
        x = _mixed(x, words[at + k])
    return x


class _Marks:
    """A set of 64-bit numbers that lets a few others through."""

    def __init__(self, numbers: np.ndarray):
        bits = max(10, int(numbers.size * 8).bit_length())
        self._shift = np.uint64(64 - bits)
        self._marked = np.zeros(1 << bits, bool)
        self._marked[self._cell(numbers)] = True

    def _cell(self, x: np.ndarray) -> np.ndarray:
        return _mixed(x, x >> np.uint64(29)) >> self._shift

    def may(self, x: np.ndarray) -> np.ndarray:
        return self._marked[self._cell(x)]


class _Numbers(_Marks):
    """A set of 64-bit numbers."""

    def __init__(self, numbers: np.ndarray):
        self.all = np.unique(numbers)
        super().__init__(self.all)

    def has(self, x: np.ndarray) -> np.ndarray:
        found = self.may(x)
        some = x[found]
        found[found] = self.all[np.minimum(np.searchsorted(self.all, some), self.all.size - 1)] == some
        return found


class Literals:
    """Literals (distinct, not empty or NULL) made ready for ``positions``."""

    def __init__(self, literals: pa.Array):
        self._raw, bounds = _bytes(literals)
        words, starts, sizes = _at_each_byte(self._raw, "<u8"), bounds[:-1], np.diff(bounds)
        first = words[starts]
        self._whole = {n: _Numbers(first[sizes == n] & _HEADS[n]) for n in range(1, WORD + 1) if (sizes == n).any()}
        self._begun = {n: _Marks(first[sizes >= n] & _HEADS[n]) for n in range(3, WORD + 1) if (sizes >= n).any()}
        self._tables = {}  # by one byte, by two, and by the first three of longer literals
        for n, fit in ((1, sizes == 1), (2, sizes == 2), (3, sizes >= 3)):
            if fit.any():
                self._tables[n] = np.zeros(1 << 8 * n, bool)
                self._tables[n][first[fit] & _HEADS[n]] = True
        # those longer than a word: their sizes, and where the literals of a hash stand
        self._sizes = np.unique(sizes[sizes > WORD]).tolist()
        own = [(starts[sizes == n], n) for n in self._sizes]
        none = np.empty(0, np.uint64)
        self._ends = _Marks(np.concatenate([none, *(_hashes(words, at, n, 1) for at, n in own)]))
        hashes = np.concatenate([none, *(_hashes(words, at, n, 16) for at, n in own)])
        order = np.argsort(hashes)
        self._words, self._hashes = words, hashes[order]
        self._starts = np.concatenate([none.astype(np.int64), *(at for at, _ in own)])[order]

    def _are(self, raw: bytes, words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Is one of the literals of the size ``n``, more than a word, at each place?"""
        hashed, found = _hashes(words, at, n, 16), np.zeros(at.size, bool)
        i, open_ = np.searchsorted(self._hashes, hashed), np.arange(at.size)
        while True:  # once, unless literals share a hash
            open_ = open_[i[open_] < self._hashes.size]
            open_ = open_[self._hashes[i[open_]] == hashed[open_]]
            if not open_.size:
                return found
            theirs = self._starts[i[open_]]
            if n > 16 * WORD:
                found[open_] = [self._raw.startswith(raw[s:s + n], t) for s, t in zip(at[open_].tolist(), theirs.tolist())]
            else:
                found[open_] = np.all([words[at[open_] + k] == self._words[theirs + k] for k in _steps(n, n)], axis=0)
            open_ = open_[~found[open_]]
            i[open_] += 1

    def _found(self, raw: bytes, words: np.ndarray, halves: np.ndarray, start: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """PLACES places from ``start`` on: those where a literal stands, and the size of the shortest."""
        low = halves[start:start + PLACES] & np.uint32(0xFFFFFF)
        free = None
        for n in (1, 2):
            if n in self._tables:
                hit = self._tables[n][low & np.uint32((1 << 8 * n) - 1)]
                if free is not None:
                    hit &= free
                free = ~hit if free is None else free & ~hit
                at = np.flatnonzero(hit) + start
                yield at, np.full(at.size, n)
        if 3 not in self._tables:
            return
        hit = self._tables[3][low]
        at = np.flatnonzero(hit if free is None else hit & free) + start
        x = words[at]
        for n in self._begun:
            if n > 3:
                near = self._begun[n].may(x & _HEADS[n])
                at, x = at[near], x[near]
            if n in self._whole:
                hit = self._whole[n].has(x & _HEADS[n])
                yield at[hit], np.full(int(hit.sum()), n)
                at, x = at[~hit], x[~hit]
        for n in self._sizes:
            fits = at + n <= words.size
            at = at[fits]
            near = np.flatnonzero(self._ends.may(_hashes(words, at, n, 1)))
            hit = near[self._are(raw, words, at[near], n)]
            yield at[hit], np.full(hit.size, n)
            at = np.delete(at, hit)

    def positions(self, texts: pa.Array) -> pa.Array:
        """Byte offsets of each text's matches: the occurrence that ends first, the longest on
        ties, and on behind it. A text that is NULL has none."""
        raw, bounds = _bytes(texts)
        words, halves = _at_each_byte(raw, "<u8"), _at_each_byte(raw, "<u4")
        found = [pair for start in range(0, int(bounds[-1]), PLACES) for pair in self._found(raw, words, halves, start)]
        none = np.empty(0, np.int64)
        starts = np.concatenate([none, *(at for at, _ in found)])
        ends = starts + np.concatenate([none, *(n for _, n in found)])
        text = np.searchsorted(bounds, starts, "right") - 1
        inside = ends <= bounds[text + 1]
        starts, ends, text = starts[inside], ends[inside], text[inside]
        order = np.lexsort((starts, ends))
        starts, ends, text = starts[order], ends[order], text[order]
        blocks, last = [none], 0
        for i in range(0, starts.size, PLACES):
            kept = []
            for j, (s, e) in enumerate(zip(starts[i:i + PLACES].tolist(), ends[i:i + PLACES].tolist()), i):
                if s >= last:  # the texts follow each other, so one pass serves all of them
                    kept.append(j)
                    last = e
            blocks.append(np.array(kept, np.int64))
        kept = np.concatenate(blocks)
        text = text[kept]
        upto = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))])
        return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(starts[kept] - bounds[text], pa.int64()))
