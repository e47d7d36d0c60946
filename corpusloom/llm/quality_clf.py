"""Quality classifier of supervised subword embeddings.

A word's features are itself and its character n-grams, and each pair of words in a row is a feature; all are hashed to
buckets with learned vectors; the pairs of a word with itself share one, so that repetition shows in words never seen
before. A text is the average of the vectors of all its features; a softmax over labels follows. Both are trained together
by stochastic gradient descent in numpy. As average and softmax input are linear, a word adds a fixed vector of logits,
which is worked out once per distinct word.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.common import Sample, added, labelled_sample, slices, with_text
from corpusloom.llm.wordtable import WordTable, code_points, grams, sums, resident

#: Buckets of words and n-grams; as many more are for pairs of words.
BUCKETS = 1 << 17
SHORTEST, LONGEST = 3, 5


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of each word itself and of its n-grams, with marks for its ends."""
    bucket, of = grams(code_points(words), tuple(range(SHORTEST, LONGEST + 1)), BUCKETS)
    whole = np.array([zlib.crc32(b"=" + w) % BUCKETS for w in words], np.int64)
    return np.concatenate([whole, bucket]), np.concatenate([np.arange(len(words)), of])


def pair_buckets(codes: np.ndarray) -> np.ndarray:
    """Buckets of the pairs of words in a row, of the words' crc32; all pairs of a word with itself have the first bucket."""
    c = codes.astype(np.uint64)
    mixed = (c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:]) * np.uint64(0xBF58476D1CE4E5B9)
    return np.where(c[:-1] == c[1:], 0, 1 + ((mixed >> np.uint64(40)) % np.uint64(BUCKETS - 1)).astype(np.int64)) + BUCKETS


@dataclass(frozen=True)
class QualityModel:
    labels: tuple[int, ...]
    vectors: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def table(self) -> WordTable:
        """Of a word: its logits, its number of features and its crc32, which a double holds exactly."""
        def make() -> WordTable:
            logits = self.logits()

            def describe(words: list[bytes]) -> np.ndarray:
                bucket, of = features(words)
                return np.column_stack([sums(logits[bucket], of, len(words)), list(map(zlib.crc32, words))])

            return WordTable(len(self.labels) + 2, describe)

        return resident(self.key, make)

    def logits(self) -> np.ndarray:
        """Of each bucket; the last column counts features."""
        return np.append(self.vectors @ self.out, np.ones((2 * BUCKETS, 1)), 1)

    def probabilities(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Softmax over labels of each text; a text without words has the bias alone."""
        table, logits = self.table(), self.logits()
        for ids in table.ids(t.split() for t in texts):
            z = self.bias.copy()
            if len(ids):
                rows = table.values[ids]
                total = rows[:, :-1].sum(0) + logits[pair_buckets(rows[:, -1])].sum(0)
                z += total[:-1] / total[-1]
            e = np.exp(z - z.max())
            yield e / e.sum()

    def scores(self, texts: list[bytes]) -> list[float]:
        """Probability of label 1."""
        at = self.labels.index(1) if 1 in self.labels else None
        return [0.0 if at is None else float(p[at]) for p in self.probabilities(texts)]


def train(sample: Sample, *, size: int = 8, epochs: int = 5, rate: float = 12.0, batch: int = 32, seed: int = 11) -> QualityModel:
    """Minibatch gradient descent with a falling rate. One label, or none: its probability is 1, or 0.5 for 0 and 1."""
    labels = tuple(sorted(set(sample.labels))) or (0, 1)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / size, 1 / size, (2 * BUCKETS, size))
    out, bias = rng.normal(0, 0.3, (size, len(labels))), np.zeros(len(labels))
    model = lambda: QualityModel(labels, vectors, out, bias)
    if len(labels) < 2 or not sample.texts:
        return model()
    names: dict[bytes, int] = {}
    pairs: dict[int, int] = {}
    docs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # numbers of the words and how often, the same of pairs
    for text in sample.texts:
        words = text.split()
        here = Counter(words)
        at = np.array([names.setdefault(w, len(names)) for w in here], np.int64)
        two, times = np.unique(pair_buckets(np.array(list(map(zlib.crc32, words)), np.uint64)), return_counts=True)
        docs.append((at, np.array(list(here.values()), float), np.array([pairs.setdefault(p, len(pairs)) for p in two.tolist()], np.int64), times.astype(float)))
    bucket, of = features(list(names))
    order = np.argsort(of, kind="stable")
    spelled = [*np.split(bucket[order], np.cumsum(np.bincount(of, minlength=len(names)))[:-1]), *[np.array([p]) for p in pairs]]
    docs = [(np.concatenate([w, p + len(names)]), np.concatenate([n, m])) for w, n, p, m in docs]
    lengths = np.array([len(x) for x in spelled])
    y = np.searchsorted(labels, sample.labels)
    weight = np.array(sample.weights())
    steps, done = epochs * max(1, len(docs) // batch), 0
    for _ in range(epochs):
        for part in np.array_split(order := rng.permutation(len(docs)), max(1, len(order) // batch)):
            pace = rate * (1 - done / steps)
            done += 1
            counts = np.array([len(docs[i][0]) for i in part])
            owner = np.repeat(np.arange(len(part)), counts)
            words, inverse = np.unique(np.concatenate([docs[i][0] for i in part]), return_inverse=True)
            share = np.concatenate([docs[i][1] for i in part])
            total = np.maximum(np.bincount(owner, share * lengths[words][inverse], len(part)), 1)
            share = share / total[owner]
            if not len(words):
                continue
            f = np.concatenate([spelled[i] for i in words])
            start = np.cumsum(lengths[words]) - lengths[words]
            word_vectors = np.add.reduceat(vectors[f], start)
            hidden = np.stack([np.bincount(owner, share * word_vectors[inverse, d], len(part)) for d in range(size)], 1)
            z = hidden @ out + bias
            e = np.exp(z - z.max(1, keepdims=True))
            g = e / e.sum(1, keepdims=True)
            g[np.arange(len(part)), y[part]] -= 1
            g *= (weight[part] / len(part))[:, None]
            back = g @ out.T
            word_grad = np.stack([np.bincount(inverse, share * back[owner, d], len(words)) for d in range(size)], 1)
            per_feature = np.repeat(word_grad, lengths[words], 0)
            touched, slot = np.unique(f, return_inverse=True)
            grad = np.stack([np.bincount(slot, per_feature[:, d], len(touched)) for d in range(size)], 1)
            vectors[touched] -= pace * len(part) * grad
            out -= pace * 0.1 * hidden.T @ g
            bias -= pace * 0.1 * g.sum(0)
    return model()


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", per_label: int = 1200, seed: int = 0, key: str = "doc_id", text: str = "text") -> QualityModel:
    """Learns from at most per_label labelled texts of each label; the weights bring back the labels' shares."""
    return train(labelled_sample(docs, labels, label, per_label=per_label, key=key, text=text, seed=seed))


def score_texts(docs: DataFrame, model: QualityModel, *, text: str = "text", name: str = "score") -> DataFrame:
    """Adds the probability of label 1 for each whole text, of any length; null and empty texts have that of the bias alone.

    A score depends on the text alone, so repeated rows and null ids need no care. An empty table stays empty. Other
    columns stay; one named like the result is replaced.
    """
    kept = [c for c in docs.columns if c != name]
    schema = added(docs, kept, f"`{name}` double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            scores = model.scores([x or b"" for x in b.column(text).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(scores, pa.float64())], [*kept, name])

    return with_text(docs, kept, text).mapInArrow(run, schema)
