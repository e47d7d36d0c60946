"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability, the logistic of a bias and the weights of its
words; the document's is their noisy-or, 1 - prod(1 - p). Weights are learned from document labels alone, by
AdaGrad on the noisy-or likelihood, so the sentence scores that come out locate what offends. In training a leak
joins the noisy-or as one more cause, the same for all documents: labels that no sentence explains go to it, not
to the number of sentences. The leak is no part of a score.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Sample, added, labelled_sample, slices, with_text
from corpusloom.llm.wordtable import PUNCTUATION, WordTable, resident

BREAK = b"."


def words_of(text: bytes) -> list[bytes]:
    """Words in order, A-Z lower-cased; a line end shows as a word of its own, a full stop."""
    return text.lower().replace(b"\n", b" . ").split()


def ends(word: bytes) -> bool:
    return word.rstrip(b"\"')]}").endswith((b".", b"!", b"?"))


def core(word: bytes) -> bytes:
    """A word without the punctuation around it; empty for punctuation alone."""
    return word.strip(PUNCTUATION)


@dataclass(frozen=True)
class ToxicityModel:
    bias: float
    weights: dict[bytes, float]  # of the words that tell; others have none
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def table(self) -> WordTable:
        def describe(words: list[bytes]) -> np.ndarray:
            return np.array([(self.weights.get(core(w), 0.0), ends(w)) for w in words], np.float64).reshape(-1, 2)

        return resident(self.key, lambda: WordTable(2, describe))

    def sentences(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each text, log-odds of its sentences and the numbers of their first words; without words one sentence without words."""
        table = self.table()
        for ids in table.ids(words_of(t) for t in texts):
            if not len(ids):
                yield np.array([self.bias]), np.zeros(1, np.int64)
                continue
            rows = table.values[ids]
            first = np.concatenate([[0], np.flatnonzero(rows[:-1, 1] > 0) + 1])
            yield self.bias + np.add.reduceat(rows[:, 0], first), first


def noisy_or(log_odds: np.ndarray) -> float:
    return float(-np.expm1(-np.logaddexp(0, log_odds).sum()))


def train(sample: Sample, *, epochs: int = 80, rate: float = 0.5, l2: float = 0.0, evidence: float = 18.0, batch: int = 200, seed: int = 7) -> ToxicityModel:
    """Fits bias and word weights by AdaGrad.

    Words take part whose rate in texts of label 1 differs from that in texts of label 0 by a likelihood ratio (G2)
    of ``evidence`` at least. For this, texts with over half of their 4-word windows in texts before them do not
    count, so that exact and near copies of one text are no evidence. Other words have weight 0. Without labelled texts, or with one label only, all weights are 0 and the bias
    gives about the share of label 1.
    """
    prior = min(max(float(sample.share.get(1, 0.0)), 1e-3), 1 - 1e-3)
    if len(set(sample.labels)) < 2 or not sample.texts:
        return ToxicityModel(float(np.log(prior / (1 - prior))), {})
    names: dict[bytes, int] = {}
    known: dict[bytes, tuple[int, bool]] = {}
    docs: list[tuple[np.ndarray, np.ndarray, int]] = []  # numbers of the words, their sentences, number of sentences
    held: list[list[np.ndarray]] = [[], []]  # numbers of the words of each text that counts, by label
    distinct = np.zeros(2)
    seen: set[int] = set()
    for text, label in zip(sample.texts, sample.labels, strict=True):
        if len(known) > 100_000:
            known.clear()
        at, where, n, begin = [], [], 0, 0
        for w in [*words_of(text), BREAK]:
            if w not in known:
                known[w] = (names.setdefault(c, len(names)) if (c := core(w)) else -1, ends(w))
            b, end = known[w]
            if b >= 0:
                at.append(b)
                where.append(n)
            if end and len(at) > begin:
                n, begin = n + 1, len(at)
        marks = {h for x in zip(at, at[1:], at[2:], at[3:]) if (h := hash(x)) % 8 == 0} or {hash(tuple(at))}  # an eighth of the windows
        if 2 * len(marks - seen) >= len(marks):
            held[label].append(np.unique(np.array(at, np.int32)))
            distinct[label] += 1
        seen |= marks
        docs.append((np.array(at, np.int32), np.array(where, np.int32), n + 1))
    counts = np.stack([np.bincount(np.concatenate([*x, np.zeros(0, np.int32)]), minlength=len(names)) for x in held]).astype(float)
    expected = counts.sum(0) * (distinct / max(distinct.sum(), 1))[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        g2 = 2 * np.nan_to_num(counts * np.log(counts / expected)).sum(0)
    usable = g2 >= evidence
    index = np.cumsum(usable) - 1
    docs = [(index[a[usable[a]]], s[usable[a]], n) for a, s, n in docs]
    w, b, leak = np.zeros(int(usable.sum())), -7.0, np.log(-np.log1p(-prior))
    gw, gb, gl = np.full(len(w), 1e-8), 1e-8, 1e-8
    y, weight = np.array(sample.labels), np.array(sample.weights())
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for part in np.array_split(order := rng.permutation(len(docs)), max(1, len(order) // batch)):
            sizes = np.array([docs[i][2] for i in part])
            base = np.cumsum(sizes) - sizes
            at = np.concatenate([docs[i][0] for i in part])
            where = np.concatenate([docs[i][1] + o for i, o in zip(part, base, strict=True)])
            z = b + np.bincount(where, w[at], sizes.sum()).astype(float)
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            total = np.add.reduceat(np.logaddexp(0, z), base) + np.exp(leak)  # -log of the probability that nothing is a cause
            pull = np.where(y[part] == 1, -1 / np.expm1(np.minimum(total, 500)), 1.0) * weight[part] / len(part)
            dz = np.repeat(pull, sizes) * p
            dw, db, dl = np.bincount(at, dz[where], len(w)).astype(float), dz.sum(), pull.sum() * np.exp(leak)
            dw += l2 * w * (dw != 0)
            gw += dw**2
            gb += db**2
            gl += dl**2
            w -= rate * dw / np.sqrt(gw)
            b -= 0.2 * rate * db / np.sqrt(gb)
            leak = max(leak - 0.2 * rate * dl / np.sqrt(gl), -10.0)
    telling = [x for x, i in names.items() if usable[i]]
    return ToxicityModel(float(b), {x: float(w[index[names[x]]]) for x in telling})


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", per_label: int = 3000, seed: int = 0, key: str = "doc_id", text: str = "text") -> ToxicityModel:
    """Learns from at most per_label labelled texts of each label; the weights bring back the labels' shares."""
    clean = labels.where(F.col(label).isin(0, 1))
    return train(labelled_sample(docs, clean, label, per_label=per_label, key=key, text=text, seed=seed))


def score_texts(docs: DataFrame, model: ToxicityModel, *, text: str = "text", name: str = "score", spans: str | None = None, span_limit: float = 0.5) -> DataFrame:
    """Adds the score of each whole text, and with ``spans`` the sentences of at least span_limit: (start word, end word, score).

    Null and empty texts and those without words have the score of one sentence without words, and no spans. Texts of any
    length are scored whole. The score depends on the text alone, so repeated rows and null ids need no care; an empty
    table stays empty. Other columns stay; those named like the results are replaced.
    """
    kept = [c for c in docs.columns if c not in (name, spans)]
    schema = added(docs, kept, f"`{name}` double" + (f", `{spans}` array<struct<start:int,end:int,score:double>>" if spans else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [x or b"" for x in b.column(text).cast(pa.binary()).to_pylist()]
            found = list(model.sentences(texts))
            columns = [*[b.column(c) for c in kept], pa.array([noisy_or(z) for z, _ in found], pa.float64())]
            if spans:
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
                columns.append(pa.array([offending(t, *x, span_limit) for t, x in zip(texts, found, strict=True)], kind))
            yield pa.RecordBatch.from_arrays(columns, [*kept, name, *([spans] if spans else [])])

    return with_text(docs, kept, text).mapInArrow(run, schema)


def offending(text: bytes, log_odds: np.ndarray, first: np.ndarray, least: float) -> list[dict]:
    """Sentences of at least that probability; word numbers count words, without line ends."""
    p = 1 / (1 + np.exp(-log_odds))
    if not (p >= least).any():
        return []
    real = np.concatenate([[0], np.cumsum([w != BREAK for w in words_of(text)])])
    bounds = [*first.tolist(), len(real) - 1]
    return [{"start": int(real[bounds[i]]), "end": int(real[bounds[i + 1]]), "score": float(p[i])} for i in np.flatnonzero(p >= least)]
