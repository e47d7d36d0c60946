"""Hand-computed cases of the text, vector and glyph functions."""

import random
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import glyphs, pii as P, text as T, text_udf as U
from corpusloom.functions.vectors import cosine, exclusive_quantile, logit


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).head()["y"]


@pytest.mark.parametrize(("text", "want"), [("a_b Été", ["a", "b", "été"]), ("", []), ("المَادَّة ١٤", ["الماده", "14"]), ("x" * 5000, ["x" * 5000])])
def test_tokens(spark, text, want):
    assert one(spark, text, T.tokens(F.col("x"))) == want


def test_tokens_of_null(spark):
    assert one(spark, None, T.tokens(F.col("x"))) is None


def test_unknown_names_raise():
    with pytest.raises(ValueError):
        T.without_stopwords(F.col("x"), "other")
    with pytest.raises(ValueError):
        T.search_tokens(F.col("x"), tokenizer="other")
    with pytest.raises(ValueError):
        T.document_text(F.col("a"), F.col("a"), F.col("p"), F.col("p"), variant="other")


def test_stopwords_keep_repeats(spark):
    assert one(spark, "law the law of", T.search_tokens(F.col("x"), stopwords="lucene")) == ["law", "law"]


def test_pack_keeps_text_and_oversize_pieces(spark):
    pieces = ["aa", "bbb", "c" * 9, "", "d"]
    packed = one(spark, pieces, T.pack(F.col("x"), 5), "array<string>")
    assert packed == ["aabbb", "c" * 9, "d"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\té​ﻻ", max_size=40))
def test_normalize_is_idempotent(text):
    once = U.normalize(text)
    assert U.normalize(once) == once
    assert "\n\n" not in once


PARTS = ["word", "+20 10 1234 5678", "+20 10 1 2 3 4 5 6 7 8", "a@b.co", "x.y@d-e.f.gh", "1", " ", "\n", "29001011234567", "29801019934567", "للسيد أحمد", "السيد محمد علي حسن", "السيد أحمد@x.com", "المهندس المعماري", "@", ".", "5"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40), st.sampled_from(["", " "]), st.integers(1, 7))
def test_redaction_of_pieces_equals_the_whole(parts, between, size):
    text = between.join(parts)
    stream = P.Pieces()
    shown = "".join(stream.take(text[i : i + size]) for i in range(0, len(text), size)) + stream.take("", last=True)
    assert shown == P.Pieces().take(text, last=True)


def test_redaction_of_rows_equals_pieces(spark):
    rng = random.Random(3)
    texts = [rng.choice(["", " "]).join(rng.choice(PARTS) for _ in range(rng.randint(0, 9))) for _ in range(500)] + [None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", P.redact(F.col("x")).alias("shown"), P.find_pii(F.col("x")).alias("found")).collect()
    for r in rows:
        assert r["shown"] == (None if r["x"] is None else P.Pieces().take(r["x"], last=True))
        assert r["x"] is None or all(r["x"][s["start"] : s["end"]].strip() and s["kind"] in P.KINDS for s in r["found"])


FOUND = [
    ("رقمي القومي 29801011234567 فهل", ["national_id"]), ("رقمي القومي ٢٩٨٠١٠١١٢٣٤٥٦٧ فهل", ["national_id"]), ("اتصل بي على 01012345678 من فضلك", ["phone"]), ("My number is +20 101 234 5678.", ["phone"]),
    ("رقمي ٠١١٢٣٤٥٦٧٨٩ للتواصل", ["phone"]), ("Write to mona.ali@example.com please.", ["email"]), ("هل يحق للسيد أحمد محمد علي أن يطالب", ["name"]), ("يضمن المهندس المعماري والمقاول", []),
    ("29013011234567", []), ("29001019934567", []), ("39902290134567", []), ("30002290134567", ["national_id"]), ("20002290134567", []), ("29602290134567", ["national_id"]), ("290010101345678", []),
    ("12345678901234", []), ("29804311234567", []), ("010 1234 5678@x.com", ["phone"]), ("01012345678@x.com", ["email"]), ("السيد أحمد@x.com", ["email"]), ("", []),
]


def test_kinds_of_personal_data(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FOUND)], "i int, x string").select("i", P.find_pii(F.col("x"))["kind"].alias("kinds")).collect()
    assert {r["i"]: r["kinds"] for r in rows} == {i: k for i, (_, k) in enumerate(FOUND)}


def test_a_long_word_takes_linear_time(spark):
    assert one(spark, "x" * 300_000 + " 1" * 1000, F.size(P.find_pii(F.col("x")))) == 0


CITED = [
    ("as provided in Article 563.", [563]), ("under Article\n221, be made", [221]), ("Articles 221 and 22 apply", [221, 22]), ("Articles 1033, 1040 and 1041 apply", [1033, 1040, 1041]), ("Articles 466 to 468", [466, 468]),
    ("وفقا للمادة ٥٦٣", [563]), ("مع مراعاة المادتين ٢٢١ ، ٢٢٢", [221, 222]), ("أحكام المادتين ٢٢١ و ٢٢٢ مراعيا", [221, 222]), ("المادتين ٢٢١-٢٢٢ من", [221, 222]), ("المادة ١١٤ فقرة ٢", [114]),
    ("أحكام المادة ١٠٣٣ وأحكام المواد من ١٠٤٠\nإلى ١٠٤٢ المتعلقة", [1033, 1040, 1042]), ("يقدم المقاول مواد من عنده", []), ("The debtor pays 7 percent within 15 days.", []), ("Article 99999999999999999999 and art. 5", [5]),
]


def test_cited_articles(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CITED)], "i int, x string").select("i", T.cited_articles(U.fold_unicode("x")).alias("n")).collect()
    assert {r["i"]: r["n"] for r in rows} == {i: n for i, (_, n) in enumerate(CITED)}


def test_cosine_of_zero_is_zero(spark):
    row = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b")).alias("c")).head()
    assert row["c"] == 0.0


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=2, max_size=30))
def test_exclusive_quantile(spark, values):
    want = statistics.quantiles(values, n=4)
    row = spark.createDataFrame([(sorted(map(float, values)),)], "x array<double>").select(*[exclusive_quantile(F.col("x"), q).alias(f"q{i}") for i, q in enumerate((0.25, 0.5, 0.75))]).head()
    assert [row[0], row[1], row[2]] == pytest.approx(want)


def test_logit_is_clipped(spark):
    assert one(spark, 1.0, logit(F.col("x")), "double") == pytest.approx(13.8155, abs=1e-3)


def glyph(c, x0, x1=None):
    return {"c": c, "x0": x0, "x1": x0 + 2 if x1 is None else x1}


def test_glyph_repairs():
    alef, lam = glyph("أ", 5.0, 5.0), glyph("ل", 5.0)
    assert glyphs.repaired([alef, lam]) == "لأ"
    assert glyphs.repaired([glyph("ب", 9.0), alef]) == "ب"  # a stray alef is no lam-alef
    assert glyphs.repaired([glyph("٣", 9.0), glyph("٢", 5.0), glyph("x", 1.0)]) == "٢٣x"
    assert glyphs.repaired([glyph(".", 1.0), glyph("ب", 9.0)]) == "ب."
    assert glyphs.repaired([glyph(" ", 1.0), glyph("a", 9.0)]) == " a"  # never past a left-to-right run
    assert glyphs.repaired([]) == ""
