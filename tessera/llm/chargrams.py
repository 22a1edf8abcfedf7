"""Hashed character n-grams of words, and sums of learned weights over the words of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.common import slabs

#: Characters of the texts that are cut into words at a time, and of the words that are cut into n-grams at a time.
SLAB_CHARS, WINDOW = 250_000, 250_000
#: Sums that are remembered for words at most, words that are remembered in any case, and the characters of words remembered.
TABLE_CELLS, LEAST_WORDS, KNOWN_CHARS = 1 << 24, 20_000, 20_000_000
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _buckets(chars: np.ndarray, n: int, bits: int) -> np.ndarray:
    h = np.full(len(chars) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * _BASE + chars[k : k + len(h)]
    return (((h ^ (h >> np.uint64(32))) * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def gram_parts(words: list[str], sizes: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word number and bucket, below 2**bits, of each n-gram of each word, in parts of bounded size; a word has a blank on either side.

    A word longer than WINDOW is read in windows that overlap, so that every n-gram comes once and none is lost.
    """
    for lo, hi in slabs(list(map(len, words)), WINDOW):
        text = f" {' '.join(words[lo:hi])} "
        step = WINDOW if hi - lo == 1 else len(text)
        for at in range(0, len(text), step):
            chars = np.frombuffer(text[at : at + step + max(sizes) - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            before = np.concatenate(([0], np.cumsum(chars == 32)))
            first = lo if at else lo - 1  # the blank before the first word stands in the first window
            for n in sizes:
                own = chars[: step + n - 1]
                if len(own) < n:
                    continue
                places = len(own) - n + 1
                inner = before[n - 1 : n - 1 + places] - before[1 : 1 + places] if n > 1 else before[1 : 1 + places] - before[:places]
                kept = np.flatnonzero(inner == 0)
                yield first + before[kept + 1], _buckets(own, n, bits)[kept]


def gram_counts(words: list[str], sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """How often each bucket occurs."""
    total = np.zeros(1 << bits, np.int64)
    for _, codes in gram_parts(words, sizes, bits):
        total += np.bincount(codes, minlength=1 << bits)
    return total


def text_slabs(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Place and texts of slabs of SLAB_CHARS characters or so, as Python's strings and words take many times the memory of the texts."""
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
    return ((lo, texts[lo:hi].to_pylist()) for lo, hi in slabs(sizes, SLAB_CHARS))


def _distinct(a: np.ndarray) -> np.ndarray:
    a.sort()
    return a[np.append(True, a[1:] != a[:-1])[: len(a)]]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """The array, twice as long or longer where it has no room for n items."""
    return a if n <= len(a) else np.concatenate((a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)))


class WordSums:
    """Sums over words of the weights of their n-grams; words met before are remembered, up to `limit` of them."""

    def __init__(self, weights: np.ndarray, sizes: tuple[int, ...], bits: int, limit: int = 300_000):
        self.weights, self.sizes, self.bits = np.ascontiguousarray(weights, np.float64), sizes, bits
        room = max(LEAST_WORDS, TABLE_CELLS // self.weights.shape[1])  # fewer words where there are many columns
        self.limit, self.slab = min(limit, room), min(200_000, room)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.table = np.zeros((1024, self.weights.shape[1]))

    def _learn(self, words: list[str]) -> None:
        lo, hi = len(self.known), len(self.known) + len(words)
        if hi > len(self.table):
            self.table = np.concatenate((self.table, np.zeros((max(hi - len(self.table), len(self.table)), self.table.shape[1]))))
        self.table[lo:hi] = 0
        for number, code in gram_parts(words, self.sizes, self.bits):
            for k in range(self.weights.shape[1]):
                self.table[lo:hi, k] += np.bincount(number, self.weights[code, k], len(words))
        self.chars += sum(map(len, words))
        self.known.update(zip(words, range(lo, hi), strict=True))

    def of(self, texts: list[list[str]]) -> np.ndarray:
        """A row for each list of words: the sums of the columns of the weights."""
        out = np.zeros((len(texts), self.weights.shape[1]))
        for lo, hi in slabs([len(t) for t in texts], self.slab):
            if len(self.known) > self.limit or self.chars > KNOWN_CHARS:
                self._forget()
            known = self.known
            if new := list({w for t in texts[lo:hi] for w in t if w not in known}):
                self._learn(new)
            sizes = [len(t) for t in texts[lo:hi]]
            rows = np.fromiter((known[w] for t in texts[lo:hi] for w in t), np.int64, sum(sizes))
            number = np.repeat(np.arange(hi - lo), sizes)
            for k in range(out.shape[1]):
                out[lo:hi, k] = np.bincount(number, self.table[rows, k], hi - lo)
        return out


class TextSums:
    """Sums of weights over the distinct n-grams of texts; words met before are remembered, up to `limit` of them."""

    def __init__(self, weights: np.ndarray, sizes: tuple[int, ...], bits: int, limit: int = 200_000):
        self.weights, self.sizes, self.bits, self.limit = np.ascontiguousarray(weights, np.float64), sizes, bits, limit
        self.seen = np.zeros(1 << bits, np.int64)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.start, self.size, self.codes, self.held = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1 << 16, np.int32), 0

    def _learn(self, words: list[str]) -> None:
        lo, hi = len(self.known), len(self.known) + len(words)
        found = [_distinct((number << self.bits) | code) for number, code in gram_parts(words, self.sizes, self.bits)]
        found = _distinct(np.concatenate([np.zeros(0, np.int64), *found]))
        size = np.bincount(found >> self.bits, minlength=len(words))
        self.start, self.size, self.codes = _room(self.start, hi), _room(self.size, hi), _room(self.codes, self.held + len(found))
        self.start[lo:hi], self.size[lo:hi] = self.held + np.cumsum(size) - size, size
        self.codes[self.held : self.held + len(found)] = found & ((1 << self.bits) - 1)
        self.held += len(found)
        self.chars += sum(map(len, words))
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))

    def of(self, texts: list[list[str]]) -> np.ndarray:
        out = np.zeros(len(texts))
        for lo, hi in slabs([len(t) for t in texts], 200_000):
            if len(self.known) > self.limit or self.chars > KNOWN_CHARS:
                self._forget()
            known = self.known
            if new := list({w for t in texts[lo:hi] for w in t if w not in known}):
                self._learn(new)
            for i in range(lo, hi):
                rows = np.fromiter((known[w] for w in texts[i]), np.int64, len(texts[i]))
                size = self.size[rows]
                place = np.arange(size.sum())
                codes = self.codes[np.repeat(self.start[rows] - np.cumsum(size) + size, size) + place]
                self.seen[codes] = place  # the last place of a code stands for it
                out[i] = self.weights[codes[self.seen[codes] == place]].sum()
        return out
