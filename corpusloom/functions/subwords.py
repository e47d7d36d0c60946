"""Subword tokens of a vocabulary: the longest piece that fits, from the left, along a trie that a worker builds once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pieces of a vocabulary at most: it goes to every worker.
MAX_PIECES = 1_000_000
_TRIES: dict[str, Trie] = {}


class Trie:
    """Pieces by their characters. A piece that begins with ``inner`` (two hashes, say) continues a word, others begin one.

    Without ``inner`` pieces stand anywhere in a word.
    """

    END = ""

    def __init__(self, pieces: Sequence[str], inner: str = "", unknown: str = "[UNK]", longest: int = 100):
        self.inner, self.unknown, self.longest = inner, unknown, longest
        self.begin: dict = {}
        self.go_on: dict = {} if inner else self.begin
        for piece in pieces:
            continues = bool(inner) and piece.startswith(inner)
            node = self.go_on if continues else self.begin
            for c in piece[len(inner) :] if continues else piece:
                node = node.setdefault(c, {})
            node[self.END] = piece

    def cut(self, word: str) -> list[str]:
        """The word's pieces; a word with a place where none fits, or of more than ``longest`` characters, is unknown as a whole."""
        if len(word) > self.longest:
            return [self.unknown]
        out, at = [], 0
        while at < len(word):
            node, found, end = self.go_on if at else self.begin, None, at
            for i in range(at, len(word)):
                node = node.get(word[i])
                if node is None:
                    break
                if self.END in node:
                    found, end = node[self.END], i + 1
            if found is None or end == at:
                return [self.unknown]
            out.append(found)
            at = end
        return out


def subword_tokens(vocabulary: Sequence[str], *, inner: str = "", unknown: str = "[UNK]", longest: int = 100) -> Callable[[Column], Column]:
    """A function from an array of words to the array of all their pieces, in order; null for null.

    The vocabulary is sent with the function, MAX_PIECES of them at most; each worker builds its trie once and cuts
    a word of a batch once.
    """
    if len(vocabulary) > MAX_PIECES:
        raise ValueError(f"{len(vocabulary)} pieces are more than {MAX_PIECES}")
    pieces = tuple(vocabulary)
    key = hashlib.sha256("\0".join((*pieces, inner, unknown, str(longest))).encode()).hexdigest()

    @F.pandas_udf("array<string>")
    def cut(words: pd.Series) -> pd.Series:
        if key not in _TRIES:
            _TRIES.clear()
            _TRIES[key] = Trie(pieces, inner, unknown, longest)
        trie, seen = _TRIES[key], {}

        def one(listed):
            if listed is None:
                return None
            out: list[str] = []
            for w in listed:
                if w not in seen:
                    seen[w] = trie.cut(w) if w is not None else []
                out += seen[w]
            return out

        return words.map(one, na_action=None)

    return cut
