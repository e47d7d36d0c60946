"""Row-by-row operators on nulls, empty and very long texts, repeated rows, empty tables and columns of clashing names."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import langid, quality_clf, quality_rules, sentencepiece_tok, toxicity
from corpusloom.llm.common import Sample

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
TEXTS = [b"good words of plain prose here", b"bad idiot words. go away"] * 40
SAMPLE = Sample(TEXTS, [1, 0] * 40, {0: 0.5, 1: 0.5})
LANGUAGES = langid.train(Sample(["the cat and the dog".encode(), "кот и собака".encode(), "猫は魚が好きです".encode(), "แมวชอบปลา".encode()], ["en", "ru", "ja", "th"], {}))
OPERATORS = {
    "toxicity": lambda d: toxicity.score_texts(d, toxicity.train(SAMPLE, evidence=1.0), spans="spans"),
    "quality_rules": quality_rules.apply_rules,
    "language": lambda d: langid.label_texts(d, LANGUAGES, spans="spans"),
    "quality": lambda d: quality_clf.score_texts(d, quality_clf.train(SAMPLE)),
    "sentencepiece": lambda d: sentencepiece_tok.encode_texts(d, MODEL),
}
MADE = {
    "toxicity": ["score", "spans"], "quality_rules": [*[n for n, _ in quality_rules.FIELDS], "base_failed", "kept"], "language": ["lang_pred", "score", "spans"], "quality": ["score"],
    "sentencepiece": [n for n, _ in sentencepiece_tok.FIELDS],
}
CLASHES = ["score", "spans", "lang_pred", "n_words", "kept", "ratio", "reason", "token_ids", "parity"]


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    if name == "sentencepiece" and not os.path.exists(MODEL):
        pytest.skip("no model file")
    texts = [None, "", " ", "\n\n", "plain words", "plain words", "word " * 300_000, "x" * 1_000_000, "猫は魚が好きです แมวชอบปลา the cat", "\x00"]
    rows = [(i if i % 3 else None, t, *["mine"] * len(CLASHES)) for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES))
    out = OPERATORS[name](df)
    got = out.collect()
    made = MADE[name]
    assert len(got) == len(rows) and set(made) <= set(out.columns)
    kept = [c for c in CLASHES if c not in made]
    assert all(r[c] == "mine" for r in got for c in kept if c in out.columns) and set(df.columns) <= set(out.columns)
    # a result depends on the text alone: equal texts, equal results
    by_text = {}
    for r in got:
        by_text.setdefault(r["text"], set()).add(str([r[c] for c in made]))
    assert len(by_text) == 9 and all(len(x) == 1 for x in by_text.values())
    empty = OPERATORS[name](df.limit(0))
    assert empty.columns == out.columns and empty.count() == 0


def test_unspaced_scripts_are_cut():
    assert langid.units("abc 猫は魚が好きです、x".encode()) == [x.encode() for x in ("abc", "猫は魚が", "好きです", "、x")]
    assert langid.units(b"a  b\tc") == [b"a", b"b", b"c"]
    text = "the cat 猫は魚が好きです the dog"
    spans = next(iter(LANGUAGES.predict([text.encode()])))[2]
    at = langid.places(text.encode())
    assert len(at) == len(langid.units(text.encode())) and [text[a:b].encode() for a, b in at] == langid.units(text.encode())
    assert spans


def test_no_language_is_left_out(spark):
    rows = [(i, f"word{i % 90} lang{i % 90} text", f"l{i % 90:02d}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(langid.fit(df, df).languages) == 90
    assert len(langid.fit(df, df, max_rows=90).languages) == 90


def test_samples_are_bounded_in_bytes(spark):
    from corpusloom.llm.common import labelled_sample

    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 5, F.repeat(F.lit("x"), 5000)).otherwise(F.repeat(F.lit("y"), 100)).alias("text"))
    labels = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("y"))
    s = labelled_sample(docs, labels, "y", per_label=20, longest=1000, all_texts=2 * 1500)
    assert s.texts and max(map(len, s.texts)) == 100 and all(sum(len(t) for t, y in zip(s.texts, s.labels, strict=True) if y == k) <= 1500 for k in (0, 1))
    assert np.isclose(sum(s.share.values()), 1) and s.share[0] == 0.5
