"""Word features that are worked out once per worker and distinct word, many words at a time, and then looked up."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np

PUNCTUATION = b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"""
SPACE = 0x20
#: Words whose features are worked out together, but for single longer texts.
TOGETHER = 100_000


class WordTable(dict):
    """Maps a word to its row in ``values``. It is emptied when it has over ``limit`` words.

    describe gives an array with a row for each of a list of words.
    """

    def __init__(self, width: int, describe: Callable[[list[bytes]], np.ndarray], limit: int = 250_000, dtype: type = np.float64):
        super().__init__()
        self.describe, self.limit = describe, limit
        self.values = np.zeros((4096, width), dtype)

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.limit:
            self.clear()
            new = list(words)
        if not new:
            return
        n = len(self)
        if n + len(new) > len(self.values):
            grown = np.zeros((max(2 * len(self.values), n + len(new)), self.values.shape[1]), self.values.dtype)
            grown[:n] = self.values[:n]
            self.values = grown
        self.values[n : n + len(new)] = self.describe(new)
        self.update(zip(new, range(n, n + len(new)), strict=True))

    def ids(self, texts: Iterable[list[bytes]]) -> Iterator[np.ndarray]:
        """For each list of words their rows' numbers, which hold until the next; no more than some texts are held at once."""
        held: list[list[bytes]] = []
        some: set[bytes] = set()
        size = 0
        for words in texts:
            held.append(words)
            some.update(words)
            size += len(words)
            if size >= TOGETHER:
                yield from self._numbers(held, some)
                held, some, size = [], set(), 0
        yield from self._numbers(held, some)

    def _numbers(self, texts: list[list[bytes]], words: set[bytes]) -> Iterator[np.ndarray]:
        self.learn(words)
        for x in texts:
            yield np.fromiter(map(self.__getitem__, x), np.int64, len(x))


_RESIDENT: dict = {}


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: workers of several tasks share an executor's limit."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def resident(key, make: Callable):
    """What a worker keeps of one model from task to task; it keeps one model at a time, whatever operator it is of."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        give_back()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def code_points(words: list[bytes], *, lower: bool = False) -> np.ndarray:
    """All words' code points, a space before, between and after them."""
    text = b" ".join([b"", *words, b""]).decode("utf-8", "replace")
    return np.frombuffer((text.lower() if lower else text).encode("utf-32-le", "replace"), "<u4")


def owners(points: np.ndarray) -> np.ndarray:
    """The number of the word that each code point, or the space before a word, is of."""
    return np.cumsum(points == SPACE) - 1


def grams(points: np.ndarray, lengths: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of all n-grams within words, the spaces around a word counting as its first and last character."""
    space = points == SPACE
    word = np.cumsum(space) - 1
    before = np.concatenate([[0], np.cumsum(space)])
    codes, of = [], []
    wide = points.astype(np.uint64) + np.uint64(1)
    for n in lengths:
        m = len(points) - n + 1
        if m <= 0:
            continue
        inside = before[n - 1 : n - 1 + m] - before[1 : 1 + m]  # spaces at the second to last but one place
        fits = inside == 0
        if n == 2:
            fits &= ~(space[:m] & space[1 : 1 + m])
        start = np.flatnonzero(fits)
        h = np.full(len(start), n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + wide[start + i]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        codes.append((h >> np.uint64(32)) % np.uint64(buckets))
        of.append(word[start])
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(codes).astype(np.int64), np.concatenate(of)


def sums(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Column sums of the rows of values by group number."""
    return np.array([np.bincount(of, values[:, k], n) for k in range(values.shape[1])]).reshape(-1, n).T
