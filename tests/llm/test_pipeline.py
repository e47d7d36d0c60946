"""The pipeline, stage by stage, against plain Python over the same rows."""

import hashlib
from collections import Counter

import pyarrow.parquet as pq
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import quality_rules as Q, toxicity
from tests.llm import brute
from tests.llm.conftest import TABLES, needs_tables

pytestmark = needs_tables
MORE = "/root/testdata/sf0.01"


def digits(text, n):
    return int(hashlib.md5(text.encode()).hexdigest()[:n], 16)


def brute_mix(rows):
    """Copies of each row: sizes in order, then hashed ids; one for each whole number that the running sum crosses."""
    size = {r["doc_id"]: len(brute.WORD.findall(r["text"])) for r in rows}
    sources = Counter()
    for r in rows:
        sources[r["source"]] += size[r["doc_id"]]
    goal, out = brute.shares(sources), {}
    for s in sources:
        here = sorted((r for r in rows if r["source"] == s), key=lambda r: (size[r["doc_id"]], digits(f"0:{r['doc_id']}:{hashlib.md5(r['text'].encode()).hexdigest()}", 15)))
        at = digits(f"0:{s or ''}", 15) >> 36
        step = round(min(goal[s] / sources[s], 3) * 2**24) if sources[s] else 0
        for r in here:
            out[r["doc_id"]] = (at + step) // 2**24 - at // 2**24
            at += step
    return out


def test_run_against_brute_force(spark, monkeypatch):
    """All stages in plain Python; only the toxicity model, which is learned, is taken from the run."""
    models, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda *a, **k: models.append(fit(*a, **k)) or models[-1])
    got = corpus_pipeline.run(spark, MORE).collect()
    rows = pq.read_table(f"{MORE}/documents.parquet").to_pylist()
    clean = [r for r in rows if brute.toxicity(r["text"], models[0].bias, models[0].weights) < 0.3]
    limits = (Q.BANDS, Q.CHUNK, Q.CHUNK_LOW, Q.CHUNK_HIGH, Q.CHUNK_LOW_SHARE, Q.CHUNK_HIGH_SHARE)
    good = [r for r in clean if not brute.base_failed(brute.base_counts(r["text"])) and brute.band_reason(r["text"], *limits) is None]
    group = brute.near_copies([r["text"] for r in good], 5, 80)
    first = {}
    for i, r in enumerate(good):
        first[group[i]] = min(r["doc_id"], first.get(group[i], r["doc_id"]))
    alone = [r for i, r in enumerate(good) if r["doc_id"] == first[group[i]]]
    assert len(rows) > len(clean) > len(good) > len(alone)
    reference = sentencepiece.SentencePieceProcessor(model_file=f"{corpus_pipeline.TOKENIZERS}/piece_bpe_32k.model")
    copies = brute_mix(alone)
    want = Counter((r["doc_id"], r["source"], tuple(reference.encode(r["text"]))) for r in alone for _ in range(copies[r["doc_id"]]))
    assert Counter((r["doc_id"], r["source"], tuple(r["token_ids"])) for r in got) == want
    assert all(r["n_tokens"] == len(r["token_ids"]) and r["round_trip"] and r["parity"] for r in got)


def test_columns_of_any_name_stay(spark):
    names = ["toxic_score", "score", "n_words", "ratio", "reason", "kept", "hash", "digest", "copies", "row", "m0", "c0", "alone"]
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, text(i), "en", "a", 1, *["mine"] * len(names)) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, TABLES)
        assert out.schema == docs.schema, name
        assert out.where(" OR ".join(f"{n} <> 'mine'" for n in names)).count() == 0 and out.count() == 6, name
        assert stage(spark, docs.limit(0), TABLES).count() == 0
    assert corpus_pipeline.encode(spark, docs, TABLES).count() == 6


def test_reruns_of_shuffled_null_and_repeated_ids_agree(spark):
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(None if i % 3 else i % 5, text(i // 2), "en", "ab"[i % 2], i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda rows: sorted(map(repr, rows))
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.mix_sources):
        once, again = (key(stage(spark, x, TABLES).collect()) for x in (docs, docs.orderBy(F.rand(7)).repartition(5)))
        assert once == again
    assert len({r[1] for r in rows}) == corpus_pipeline.drop_near_duplicates(spark, docs, TABLES).select("text").distinct().count()


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"word{i}" for i in range(40))
    other = " ".join(f"other{i}" for i in range(40))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, "en", "b", 1), (3, other, "en", None, 1), (None, other + " more", "en", None, 1), (4, None, "en", "a", 0), (4, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, TABLES).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in out) == [(False, 1), (False, 3), (False, 4)]
    assert corpus_pipeline.mix_sources(spark, docs.limit(0), TABLES).count() == 0


def test_other_texts_of_null_and_repeated_ids_stay(spark):
    text = lambda w: " ".join(f"{w}{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("b")), (None, text("b") + " more"), (7, text("c")), (7, text("d")), (8, text("d") + " more"), (9, None), (9, ""), (9, ""), (None, None), (None, " ")]
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, TABLES)
    got = Counter((r["doc_id"], (r["text"] or "")[:2]) for r in out.collect())
    assert got == {(None, "a0"): 1, (None, "b0"): 1, (7, "c0"): 1, (7, "d0"): 1, (9, ""): 2, (None, ""): 1, (None, " "): 1}
    mixed = corpus_pipeline.mix_sources(spark, out, TABLES)
    assert {(r["doc_id"], (r["text"] or "")[:2]) for r in mixed.collect()} == set(got)
