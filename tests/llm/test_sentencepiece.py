import os
import random

import pytest

from corpusloom.llm import sentencepiece_tok as S
from tests.llm.conftest import TABLES, needs_tables

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")
ODD = ["", " ", "  ", " a", "a ", "a  b", "\n\n x", "▁▁a", "a▁b", "▁", "日本語 text", "\x00\x01", "<s> </s> <unk> <0x0A>", "é́ ﬁ", "   lead", "tab\there", "a\u00a0b", " \n ", "x" * 5000, "👩‍👩‍👧 emoji", "trailing   ", "\ufeffbom"]


@pytest.fixture(scope="module")
def codec():
    with open(MODEL, "rb") as f:
        return S.Codec(f.read())


def test_parity_and_round_trip(codec):
    want = codec.reference.encode(ODD, num_threads=1)
    got = codec.encode(ODD)
    assert [ids for ids, _ in got] == want
    assert all(same for _, same in got)
    assert [codec.decode(x) for x in want] == [codec.tokenizer.decode(x, skip_special_tokens=False) for x in want]
    assert [codec.decode(x) for x, t in zip(want, ODD, strict=True) if META_FREE(t)] == [t for t in ODD if META_FREE(t)]


def META_FREE(text):
    return S.META not in text


def varint(n):
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def message(*fields):
    import struct

    out = b""
    for n, v in fields:
        if isinstance(v, float):
            out += varint(n << 3 | 5) + struct.pack("<f", v)
        elif isinstance(v, int):
            out += varint(n << 3) + varint(v)
        else:
            out += varint(n << 3 | 2) + varint(len(v)) + v
    return out


def unigram():
    """A hand-made unigram model with byte fallback."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]]
    pieces += [("▁", -2.0, 1), ("▁the", -1.0, 1), ("▁cat", -1.5, 1), ("a", -3.0, 1), ("t", -3.1, 1), ("at", -3.2, 1), ("s", -2.5, 1), ("c", -4.0, 1), ("h", -4.1, 1), ("e", -4.2, 1), ("th", -4.05, 1)]
    rows = [(1, message((1, p.encode()), (2, s), (3, k))) for p, s, k in pieces]
    return message(*rows, (2, message((3, 1), (35, 1))), (3, message((1, b"identity"), (3, 1), (4, 0), (5, 1))))


def test_unigram_models(codec):
    data = unigram()
    made = S.Codec(data)
    assert made.model.kind == S.UNIGRAM and made.model.byte_fallback
    texts = ["the cat", "cats", "hat the", "é", "that cat sat", "the  cat", " x"]
    assert [ids for ids, _ in made.encode(texts)] == made.reference.encode(texts, num_threads=1)
    assert all(same for _, same in made.encode(texts))
    assert [made.decode(ids) for ids, _ in made.encode(texts)] == texts


def test_wire_format_refuses_groups():
    with pytest.raises(ValueError):
        list(S.wire(b"\x0b"))


def test_rows(spark, codec):
    rows = [(1, None), (2, ""), (3, "Some text here"), (3, "Some text here"), (None, "x"), (4, "long text " * 40_000)]
    df = spark.createDataFrame([(*r, "old") for r in rows], "doc_id int, text string, parity string")
    out = S.encode_texts(df, MODEL)
    got = out.collect()
    assert len(got) == 6
    by = {r["doc_id"]: r for r in got}
    assert by[1]["token_ids"] is None and by[1]["n_tokens"] is None and by[1]["round_trip"] is None
    assert by[2]["token_ids"] == [] and by[2]["n_tokens"] == 0 and by[2]["round_trip"]
    assert all(r["parity"] and r["round_trip"] for r in got if r["doc_id"] != 1)
    back = {r["doc_id"]: r["decoded"] for r in S.decode_ids(out.select("doc_id", "token_ids"), MODEL).collect()}
    assert back[3] == "Some text here" and back[1] is None and back[2] == ""
    assert S.encode_texts(df.limit(0), MODEL).count() == 0


def test_threads_are_the_cores_of_a_task(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(S, "task_cores", lambda s: asked.append(s) or 3)
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [r["parity"] for r in S.encode_texts(docs, MODEL).orderBy("doc_id").collect()][0] and asked == [spark]
    monkeypatch.undo()
    assert S.task_cores(spark) == int(spark.sparkContext.getConf().get("spark.task.cpus", "1"))


def test_long_texts_are_cut_to_the_same_ids(codec, monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["word", " ", "  ", "é", "\n", S.META, "a", " b", "日本"]) for _ in range(200)) for _ in range(200)]
    want = codec.reference.encode(texts, num_threads=1)
    monkeypatch.setattr(S, "LONG_CHARS", 30)
    assert codec.cuts and max(len(codec.parts(t)) for t in texts) > 5
    assert [ids for ids, _ in codec.encode(texts)] == want and all(same for _, same in codec.encode(texts))


def test_parity_says_what_differs(codec):
    class Other:
        def encode(self, texts, num_threads):
            return [[*ids, 5] if t == "b c" else ids for t, ids in zip(texts, codec.reference.encode(texts, num_threads=1), strict=True)]

    other = S.Codec.__new__(S.Codec)
    other.__dict__.update(codec.__dict__)
    other.reference = Other()
    assert [same for _, same in other.encode(["a", "b c", ""])] == [True, False, True]


def test_parity_on_hostile_texts(codec):
    rng = random.Random(8)
    parts = ["word", " ", "  ", "é", "\n", "\t", S.META, "a", "B", " b", "日本", "ﬁ", "\x00", "👩‍👧", "<s>", "<0x0A>", "ing", "\u00a0", "123", ".", "\ufeff", "ه", "́"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(20_000)]
    assert all(same for _, same in codec.encode(texts))


def test_texts_are_cut_every_some_words_to_the_same_ids(codec):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["word", " ", "  ", "   ", "é", "\n", S.META, "a", " b", " the", " 日本", "."]) for _ in range(300)) for _ in range(500)]
    texts += [" ".join(["word"] * n) for n in (S.WORDS - 1, S.WORDS, S.WORDS + 1, 40 * S.WORDS)]
    assert [ids for ids, _ in codec.encode(texts)] == codec.reference.encode(texts, num_threads=1)
    cut = codec.tokenizer.pre_tokenizer.pre_tokenize_str
    marked = [S.META + t.replace(" ", S.META) for t in texts]
    assert all("".join(x for x, _ in cut(t)) == t for t in marked)
    assert [len(cut(t)) for t in marked[-4:]] == [1, 1, 2, 40]
    made = S.Codec(unigram())
    assert len(made.tokenizer.pre_tokenizer.pre_tokenize_str("▁the▁cat▁▁sat▁")) == 4


def together(codec, texts, found):
    import numpy as np

    flat = np.array([i for ids in found for i in ids], np.int32)
    return codec.returns(texts, found, flat, np.cumsum([0, *map(len, found)]))


def test_round_trips_are_found_together(codec, monkeypatch):
    texts = [t for t in ODD if META_FREE(t)]
    found = [ids for ids, _ in codec.encode(texts)]
    asked = []
    decode = codec.decode
    monkeypatch.setattr(codec, "decode", lambda ids: asked.append(ids) or decode(ids))
    assert together(codec, texts, found) == [True] * len(texts) and not asked
    assert together(codec, [], []) == [] and together(codec, [None, "", None], [[], [], []]) == [False, True, False]
    # ids of another text, bytes that are no text, and text that only looks like a piece with a marker
    bad = codec.tokenizer.token_to_id("<0xE9>")
    other = [found[i - 1] for i in range(len(texts))]
    assert together(codec, [*texts, "é", "a b"], [*other, [bad], codec.encode([f"a{S.META}b"])[0][0]]) == [decode(x) == t for x, t in zip(other, texts, strict=True)] + [False, True]
    assert asked


@needs_tables
def test_query_against_both_libraries(spark, codec):
    """The query's digests, counts and flags of every document are those of whole texts, encoded one by one."""
    from pyspark.sql import functions as F

    from corpusloom.llm.queries import op7_sentencepiece

    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()
    rows = []
    for r in docs:
        ids = None if r["text"] is None else codec.reference.encode(r["text"])
        rows.append((r["doc_id"], ids, None if ids is None else sum(bool(codec.is_byte[i]) for i in ids), None if ids is None else codec.reference.decode(ids) == r["text"]))
    want = spark.createDataFrame(rows, "doc_id long, ids array<int>, n_byte_tokens int, round_trip boolean")
    want = want.select("doc_id", F.size("ids").alias("n_tokens"), "n_byte_tokens", F.xxhash64("ids").alias("ids_hash"), "round_trip", F.lit(True).alias("parity"))
    assert sorted(map(tuple, op7_sentencepiece(spark, TABLES).collect())) == sorted(map(tuple, want.collect()))
