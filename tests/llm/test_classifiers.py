import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import langid, quality_clf, toxicity
from corpusloom.llm.common import Sample, labelled_sample
from tests.llm.conftest import needs_tables

MEDIUM = "/root/testdata/sf0.1"


def plain_toxicity(model, text):
    """Noisy-or, sentence by sentence."""
    total, rest = 1.0, 1.0
    sentences, now = [], []
    for w in toxicity.words_of(text):
        now.append(w)
        if toxicity.ends(w):
            sentences.append(now)
            now = []
    if now or not sentences:
        sentences.append(now)
    for s in sentences:
        z = model.bias + sum(model.weights.get(toxicity.core(w), 0.0) for w in s)
        rest *= 1 - 1 / (1 + np.exp(-z))
    return total - rest


@pytest.fixture(scope="module")
def toxic_model():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(60)] + ["all", "good", "is", "well", "what", "nice"]
    texts, labels = [], []
    for i in range(400):
        sentences = [[str(w) for w in rng.choice(words, 7)] for _ in range(4)]
        if i % 4 == 0:
            sentences[rng.integers(4)][3] = "idiot"
        texts.append(". ".join(map(" ".join, sentences)).encode())
        labels.append(int(i % 4 == 0))
    return toxicity.train(Sample(texts, labels, {0: 0.75, 1: 0.25}))


def test_toxicity_learns_the_word_and_its_sentence(spark, toxic_model):
    df = spark.createDataFrame([(1, "All good. What an idiot! Bye now.", 9), (2, "all is well. nice", 9), (3, None, 9), (4, "", 9), (5, "\n \n", 9), (6, "word " * 60_000, 9)], "doc_id int, text string, score int")
    rows = {r["doc_id"]: r for r in toxicity.score_texts(df, toxic_model, spans="spans").collect()}
    assert rows[1]["score"] > 0.8 > 0.2 > rows[2]["score"]
    assert [(s["start"], s["end"]) for s in rows[1]["spans"]] == [(2, 5)]
    assert rows[3]["score"] == rows[4]["score"] and rows[3]["spans"] == []
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_toxicity_against_brute_force(toxic_model):
    texts = [b"an idiot. and idiot\nidiot", b"", b"...", b"no end", b"a.b c! \"d?\" e", "é idiot.".encode()]
    for t, (z, _) in zip(texts, toxic_model.sentences(texts), strict=True):
        assert toxicity.noisy_or(z) == pytest.approx(plain_toxicity(toxic_model, t), abs=1e-12)


def test_training_without_telling_words():
    model = toxicity.train(Sample([b"a b", b"c d. e"], [0, 1], {0: 0.5, 1: 0.5}))
    assert not model.weights


def test_training_without_examples():
    assert not toxicity.train(Sample([], [], {})).weights
    assert 0 < next(iter([toxicity.noisy_or(z) for z, _ in toxicity.train(Sample([b"a"], [1], {1: 1.0})).sentences([b"x"])])) <= 1
    assert quality_clf.train(Sample([], [], {})).scores([b"x", b""]) == pytest.approx([0.5, 0.5], abs=0.2)
    assert [x[:2] for x in langid.train(Sample([], [], {})).predict([b"abc"])] == [("und", 0.0)]


def plain_quality(model, text):
    words = text.split()
    total = np.zeros(len(model.labels) + 1)
    logits = model.logits()
    for i, w in enumerate(words):
        total += logits[quality_clf.features([w])[0]].sum(0)
        if i:
            total += logits[quality_clf.pair_buckets(np.array([zlib.crc32(words[i - 1]), zlib.crc32(w)]))[0]]
    z = model.bias + (total[:-1] / total[-1] if words else 0)
    e = np.exp(z - z.max())
    return e / e.sum()


def test_pairs_of_words():
    a, b, c = (zlib.crc32(x) for x in (b"a", b"b", b"c"))
    got = quality_clf.pair_buckets(np.array([a, b, b, c, c, a, b]))
    assert got[1] == got[3] == quality_clf.BUCKETS and got[0] == got[5] and len(set(got)) == 4
    assert got.min() >= quality_clf.BUCKETS and got.max() < 2 * quality_clf.BUCKETS and len(quality_clf.pair_buckets(np.zeros(1))) == 0


def test_one_step_follows_the_gradient():
    """The trainer's step on one batch is the gradient of the weighted log-likelihood, by differences."""
    texts, labels = [b"aa bb aa", b"cc bb bb", b"dd"], [1, 0, 1]
    sample = Sample(texts, labels, {0: 1 / 3, 1: 2 / 3})
    rate, size = 1e-3, 4
    start = quality_clf.train(sample, size=size, epochs=0)
    after = quality_clf.train(sample, size=size, epochs=1, rate=rate, batch=3)

    def loss(vectors, out, bias):
        model = quality_clf.QualityModel(start.labels, vectors, out, bias)
        return -sum(w * np.log(plain_quality(model, t)[start.labels.index(y)]) for t, y, w in zip(texts, labels, sample.weights(), strict=True)) / 3

    used = sorted({*quality_clf.features([b"aa", b"bb", b"cc", b"dd"])[0].tolist(), quality_clf.BUCKETS})
    for at in used[::5]:
        for k in range(size):
            up = start.vectors.copy()
            up[at, k] += 1e-5
            slope = (loss(up, start.out, start.bias) - loss(start.vectors, start.out, start.bias)) / 1e-5
            assert after.vectors[at, k] - start.vectors[at, k] == pytest.approx(-rate * 3 * slope, abs=1e-8)
    up = start.bias + np.array([1e-5, 0])
    slope = (loss(start.vectors, start.out, up) - loss(start.vectors, start.out, start.bias)) / 1e-5
    assert after.bias[0] - start.bias[0] == pytest.approx(-rate * 0.1 * slope, abs=1e-8)


def test_quality_against_brute_force(spark):
    good, bad = [b"plain words of prose number %d" % i for i in range(80)], [b"$$$ buy!!! ### %d" % i for i in range(80)]
    model = quality_clf.train(Sample(good + bad, [1] * 80 + [0] * 80, {0: 0.5, 1: 0.5}))
    texts = [b"plain words", b"$$$ ###", b"", b"go go go", "été".encode()]
    for t, p in zip(texts, model.probabilities(texts), strict=True):
        assert p == pytest.approx(plain_quality(model, t), abs=1e-9)
    assert model.scores([b"words of prose"])[0] > 0.5 > model.scores([b"### $$$ buy!!!"])[0]
    df = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "", 1), (2, "x" * 200_000, 1)], "doc_id int, text string, score int")
    rows = quality_clf.score_texts(df, model).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)


def plain_viterbi(z, penalty):
    n, best = z.shape[1], None
    total = np.zeros(n)
    paths = [[] for _ in range(n)]
    for row in z:
        new, moved = [], []
        for j in range(n):
            i = max(range(n), key=lambda i: total[i] - (penalty if i != j else 0))
            new.append(total[i] - (penalty if i != j else 0) + row[j])
            moved.append([*paths[i], j])
        total, paths = np.array(new), moved
    best = paths[int(total.argmax())]
    return best


def value(z, path, penalty):
    return sum(z[i, k] for i, k in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:], strict=False))


def test_spans_are_a_best_path():
    rng = np.random.default_rng(4)
    model = langid.LanguageModel(("a", "b", "c"), np.zeros((langid.BUCKETS, 3)), np.ones((langid.OTHER + 1, 3), bool), penalty=3.0)
    for _ in range(300):
        z = np.repeat(rng.normal(0, 1.5, (rng.integers(1, 8), 3)), rng.integers(1, 6), 0)
        spans, count = model.spans(np.append(z, np.ones((len(z), 1)), 1))
        path = [k for a, b, k in spans for _ in range(b - a)]
        assert value(z, path, 3.0) == pytest.approx(value(z, plain_viterbi(z, 3.0), 3.0))
        assert count.sum() == len(z)


def test_language_edges_and_scripts(spark):
    texts = [b"the cat and the dog are here", b"this is the house of the king", "кот и собака в доме".encode(), "это дом короля и кот".encode(), b"le chat et le chien sont ici", b"la maison du roi et le chat"]
    model = langid.train(Sample(texts, ["en", "en", "ru", "ru", "fr", "fr"], {}))
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "the dog and the king"), (5, "дом"), (6, "the cat and the dog and the king is here кот и собака это дом короля и кот в доме"), (7, "the " * 40_000), (8, "漢字")]
    df = spark.createDataFrame([(*r, "old") for r in rows], "doc_id int, text string, lang_pred string")
    got = {r["doc_id"]: r for r in langid.label_texts(df, model, spans="spans").collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["spans"] == []
    assert [got[i]["lang_pred"] for i in (4, 5, 7)] == ["en", "ru", "en"]
    assert [(s["lang"]) for s in got[6]["spans"]] == ["en", "ru"]
    assert got[8]["lang_pred"] in ("en", "fr", "ru") and 0 <= got[8]["score"] <= 1


def test_sample_is_bounded_and_clean(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(300)] + [(5, "a copy"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 // 2) for i in range(300)] + [(7, 0), (7, 1), (None, 1), (9, None)], "doc_id long, toxic int")
    s = labelled_sample(docs, labels, "toxic", per_label=20)
    assert Counter(s.labels) == {0: 20, 1: 20}
    assert s == labelled_sample(docs, labels, "toxic", per_label=20)
    assert b"t7" not in s.texts and s.share[0] == pytest.approx(2 / 3, abs=0.01)
    assert sum(s.weights()) == pytest.approx(40)
    assert labelled_sample(docs, labels.limit(0), "toxic", per_label=20) == Sample([], [], {})


@needs_tables
def test_held_out_accuracy(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()
    fold = lambda d, n: zlib.crc32(str(d).encode()) % n
    from corpusloom.llm.queries import op3_toxicity, op8_language_id, op10_quality_classifier

    toxic = {r["doc_id"]: r for r in op3_toxicity(spark, MEDIUM).collect()}
    assert len(toxic) == len(docs) and all(r["held_out"] == (fold(d, 4) == 2) for d, r in toxic.items())
    held = [(r["toxic"], toxic[r["doc_id"]]["predicted"]) for r in labels if toxic[r["doc_id"]]["held_out"]]
    assert sum(p for y, p in held if y) / sum(y for y, _ in held) > 0.7
    assert sum(p for y, p in held if not y) / sum(1 - y for y, _ in held) < 0.03
    language = op8_language_id(spark, MEDIUM).collect()
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in language if r["held_out"]]) > 0.98
    quality = {r["doc_id"]: r for r in op10_quality_classifier(spark, MEDIUM).collect()}
    assert all(r["held_out"] == (fold(d, 5) == 0) for d, r in quality.items())
    assert np.mean([quality[r["doc_id"]]["predicted"] == r["quality"] for r in labels if quality[r["doc_id"]]["held_out"]]) > 0.95
