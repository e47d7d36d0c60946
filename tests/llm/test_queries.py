"""The queries that SQL cannot express, whole tables against plain Python."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from corpusloom.llm import langid, quality_clf, quality_rules as Q, queries, toxicity
from corpusloom.llm.common import Sample
from tests.llm import brute
from tests.llm.conftest import TABLES, needs_tables

pytestmark = needs_tables


@pytest.fixture(scope="module")
def rows():
    return pq.read_table(f"{TABLES}/documents.parquet").to_pylist()


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def caught(monkeypatch, module):
    """The models that a query fits."""
    models, fit = [], module.fit
    monkeypatch.setattr(module, "fit", lambda *a, **k: models.append(fit(*a, **k)) or models[-1])
    return models


def test_toxicity_query(spark, rows, monkeypatch):
    models = caught(monkeypatch, toxicity)
    got = {r["doc_id"]: r for r in queries.op3_toxicity(spark, TABLES).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g, want = got[r["doc_id"]], brute.toxicity(r["text"], models[0].bias, models[0].weights)
        assert g["score"] == pytest.approx(want, abs=1e-9) and g["predicted"] == int(g["score"] >= 0.3) and g["held_out"] == (fold(r["doc_id"], 4) == 2)


def test_quality_rules_query(spark, rows):
    limits = (Q.BANDS, Q.CHUNK, Q.CHUNK_LOW, Q.CHUNK_HIGH, Q.CHUNK_LOW_SHARE, Q.CHUNK_HIGH_SHARE)
    want = []
    for r in rows:
        counts, reason = brute.base_counts(r["text"]), brute.band_reason(r["text"], *limits)
        want.append((r["doc_id"], *counts, brute.base_failed(counts), not brute.base_failed(counts) and reason is None, reason))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason"]
    got = [tuple(r) for r in queries.op4_quality_rules(spark, TABLES).select(*names).collect()]
    assert sorted(got) == sorted(want)


def test_language_query(spark, rows, monkeypatch):
    """Evidence by word from the model's tables, then the best path of all."""
    models = caught(monkeypatch, langid)
    got = {r["doc_id"]: r for r in queries.op8_language_id(spark, TABLES).collect()}
    m = models[0]
    assert m.languages == tuple(sorted({r["lang"] for r in rows if r["lang"] is not None and fold(r["doc_id"], 4) != 2}))

    def evidence(word):
        lower = [c for c in word.lower() if c.isalpha()]
        padded = [32, *[ord(c) for c in lower], 32]
        total = np.zeros(len(m.languages))
        for n in langid.GRAMS:
            for i in range(len(padded) - n + 1):
                if not (n == 2 and not lower):
                    total += m.logp[bucket(padded[i : i + n])]
        script = Counter(next((k for k, (_, blocks) in enumerate(langid.SCRIPTS) if any(a <= ord(c) <= b for a, b in blocks)), langid.OTHER) for c in lower)
        if not lower:
            return total * 0, 0
        most = min(script, key=lambda k: (-script[k], k))
        may = m.uses[most]
        if not may.any():
            return total * 0, len(lower)
        z = np.clip(total - total[may].mean(), -m.clip, m.clip)
        return np.where(may, z, -m.clip), len(lower)

    def bucket(points):
        h = len(points)
        for p in points:
            h = (h * 0x9E3779B97F4A7C15 + p + 1) % 2**64
        h ^= h >> 29
        return (h * 0xBF58476D1CE4E5B9 % 2**64 >> 32) % langid.BUCKETS

    known = {}
    for r in rows:
        words = brute.WORD.findall(r["text"] or "")
        found = [known.setdefault(w, evidence(w)) for w in words]
        g = got[r["doc_id"]]
        if not sum(n for _, n in found):
            assert (g["lang_pred"], g["score"]) == ("und", 0.0)
            continue
        z = np.array([e for e, _ in found])
        path = [k for a, b, k in next(iter(m.predict([r["text"].encode()])))[2] for _ in range(b - a)]
        value = sum(z[i, k] for i, k in enumerate(path)) - m.penalty * sum(a != b for a, b in zip(path, path[1:], strict=False))
        assert len(path) == len(words) and value == pytest.approx(brute.best_path_value(z.tolist(), m.penalty), abs=1e-6)
        count = Counter()
        for k, (_, n) in zip(path, found, strict=True):
            count[k] += n
        top = min(count, key=lambda k: (-count[k], k))
        assert g["lang_pred"] == m.languages[top] and g["score"] == pytest.approx(count[top] / sum(count.values()))


def test_quality_query(spark, rows, monkeypatch):
    models = caught(monkeypatch, quality_clf)
    got = {r["doc_id"]: r for r in queries.op10_quality_classifier(spark, TABLES).collect()}
    m = models[0]
    logits = np.append(m.vectors @ m.out, np.ones((len(m.vectors), 1)), 1)

    def gram(points):
        h = len(points)
        for p in points:
            h = (h * 0x9E3779B97F4A7C15 + p + 1) % 2**64
        h ^= h >> 29
        return (h * 0xBF58476D1CE4E5B9 % 2**64 >> 32) % quality_clf.BUCKETS

    def word(w):
        padded = [32, *map(ord, w), 32]
        at = [zlib.crc32(b"=" + w.encode()) % quality_clf.BUCKETS]
        at += [gram(padded[i : i + n]) for n in range(quality_clf.SHORTEST, quality_clf.LONGEST + 1) for i in range(len(padded) - n + 1)]
        return logits[at].sum(0)

    def pair(a, b):
        if a == b:
            return logits[quality_clf.BUCKETS]
        x = (zlib.crc32(a.encode()) * 0x9E3779B97F4A7C15 + zlib.crc32(b.encode())) * 0xBF58476D1CE4E5B9 % 2**64
        return logits[quality_clf.BUCKETS + 1 + (x >> 40) % (quality_clf.BUCKETS - 1)]

    known = {}
    for r in rows:
        words, z = brute.WORD.findall(r["text"] or ""), m.bias
        if words:
            total = sum(known[w] if w in known else known.setdefault(w, word(w)) for w in words) + sum((pair(a, b) for a, b in zip(words, words[1:], strict=False)), np.zeros(len(z) + 1))
            z = z + total[:-1] / total[-1]
        e = np.exp(z - z.max())
        g = got[r["doc_id"]]
        assert g["score"] == pytest.approx((e / e.sum())[m.labels.index(1)], abs=1e-9) and g["predicted"] == int(g["score"] >= 0.3) and g["held_out"] == (fold(r["doc_id"], 5) == 0)


def test_toxicity_training_by_hand():
    """The words that tell by G2, and the signs of a first full step, from the definition."""
    texts = [b"bad thing here. fine.", b"quite bad day", b"so bad it is", b"good day", b"fine thing. good", b"it is good here", b"quite fine", b"so good"]
    labels = [1, 1, 1, 0, 0, 0, 0, 0]
    sample = Sample(texts, labels, {0: 5 / 8, 1: 3 / 8})
    held = [[{w for s in brute.sentences(t.decode()) for w in s} for t, y in zip(texts, labels, strict=True) if y == k] for k in (0, 1)]

    def g2(w):
        n = [sum(w in x for x in h) for h in held]
        want = [sum(n) * len(h) / len(texts) for h in held]
        return 2 * sum(a * math.log(a / e) for a, e in zip(n, want, strict=True) if a)

    words = {w for h in held for x in h for w in x}
    model = toxicity.train(sample, evidence=3.0, epochs=1)
    assert set(model.weights) == {w.encode() for w in words if g2(w) >= 3.0} == {b"bad", b"good"}
    # AdaGrad's first step has the rate's size, 0.5, but for what its sum of squares begins with
    assert model.weights[b"bad"] == pytest.approx(0.5, abs=0.02) and model.weights[b"good"] == pytest.approx(-0.5, abs=0.02)
