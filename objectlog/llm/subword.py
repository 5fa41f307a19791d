"""Hashed character n-grams of words, vectorised over many words at once, and per-word score caches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Multipliers of the polynomial hash and of its final mix; fixed values, so that stored models stay valid.
BASE, MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)

#: ASCII letters and digits stay, every other ASCII byte turns to a space, bytes of longer code points stay.
LETTERS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words of a whole text, without ASCII punctuation."""
    return text.lower().encode("utf-8", "replace").translate(LETTERS).split() if text else []


def ngram_ids(words: list[bytes], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every byte n-gram of ``<word>`` and of the whole word; buckets is a power of two."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    text = np.frombuffer(b"<" + b"><".join(words) + b">", dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    left = np.repeat(start + size, size) - np.arange(len(text))  # bytes from here to the word's end
    own, ids, shift = [], [], np.uint64(64 - (buckets - 1).bit_length())
    h = np.zeros(len(text), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(sizes) + 1):
            h = h[: len(text) - n + 1] * BASE + text[n - 1 :] if len(text) >= n else h[:0]
            if n in sizes:
                ok = left[: len(h)] >= n
                own.append(word[: len(h)][ok])
                ids.append(((h[ok] * MIX + np.uint64(n)) * MIX) >> shift)
        power = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(int(size.max()) - 1, 1), BASE))))
        whole = np.add.reduceat(text * power[np.arange(len(text)) - np.repeat(start, size)], start)
        own.append(np.arange(len(words)))
        ids.append((whole * MIX * MIX) >> shift)
    return np.concatenate(own), np.concatenate(ids).astype(np.int64)


def word_sums(words: list[bytes], weights: np.ndarray, sizes: tuple[int, ...], mean: bool) -> np.ndarray:
    """For each word the sum (or mean) of its n-grams' rows of ``weights``: an array (words, columns)."""
    own, ids = ngram_ids(words, sizes, len(weights))
    out = np.stack([np.bincount(own, weights[ids, c], len(words)) for c in range(weights.shape[1])], axis=1) if words else np.empty((0, weights.shape[1]))
    if mean and words:
        out /= np.bincount(own, minlength=len(words))[:, None]
    return out


class WordCache:
    """Scores of words, computed once for each distinct word a worker meets; emptied when it holds ``most`` words."""

    def __init__(self, score: Callable[[list[bytes]], np.ndarray], most: int = 200_000):
        self.score, self.most = score, most
        self.index: dict[bytes, int] = {}
        self.rows = np.empty((0, 1), np.float32)

    def add(self, bags: list[list[bytes]]) -> None:
        """Make sure that every word of the bags has its row."""
        if len(self.index) > self.most:
            self.index, self.rows = {}, np.empty((0, self.rows.shape[1]), np.float32)
        new = list({w for bag in bags for w in bag} - self.index.keys())
        if new:
            rows = self.score(new).astype(np.float32)
            first, end = len(self.index), len(self.index) + len(new)
            if end > len(self.rows):  # room for more, so that it is seldom copied
                grown = np.empty((max(2 * len(self.rows), end), rows.shape[1]), np.float32)
                grown[:first] = self.rows[:first] if first else 0
                self.rows = grown
            self.rows[first:end] = rows
            self.index.update(zip(new, range(first, end), strict=True))

    def of(self, bag: list[bytes]) -> np.ndarray:
        return self.rows[np.fromiter(map(self.index.__getitem__, bag), np.int64, len(bag))]

    def mean(self, bag: list[bytes], columns: int, step: int = 100_000) -> np.ndarray:
        """The mean of the words' rows (0 without words), summed in parts so that a long text takes no more than they do."""
        total = np.zeros(columns)
        for at in range(0, len(bag), step):
            total += self.of(bag[at : at + step]).sum(0, dtype=float)
        return total / max(len(bag), 1)
