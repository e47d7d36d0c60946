"""Queries against their SQL on rows that only larger tables hold, and jobs that must not grow faster than their input."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import pii as P, text as T
from corpusloom.operators import records as O, retrieval as R
from corpusloom.plans import catalogue


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query gives its SQL's rows over tables given as (rows, schema)."""

    def compare(name: str, **tables) -> bool:
        con = duckdb.connect()
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
        got = catalogue.QUERIES[name](spark, str(tmp_path))
        want = con.execute(catalogue.ORACLES[name])
        columns = [c[0] for c in want.description]
        return sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))

    return compare


def test_pieces_that_overlap_by_half(spark, same):
    """Sums of an edge and a height are rounded, which moved half overlaps to either side."""
    rows = [(e, 1, v) for e, v in enumerate([0.3, 5.3, 0.1, 5.1, 11.3, 6.3, 1.3, 6.4, 7.7, 2.7, -3.3, 1.7, None])]
    assert same("visual_lines", events=(rows, "event_id long, user_id long, value double"))


def test_blanks_around_highlighted_text(same):
    """Blanks as SQL's trim knows them: space separators, but no line breaks; a null text stays null."""
    rows = [(1, "x\nEstiin is haed end"), (2, "ab \u00a0\u3000cde fgh ijk \u2009"), (3, None), (4, ""), (5, "abcde. . fg\t \n ")]
    assert same("highlighted_lines", benchmark=(rows, "item_id long, text string"))


def test_many_findings_take_linear_time(spark):
    """Each of a text's findings used to copy what was shown before it."""
    text = "+20 10 0001 4321, 29001011200001, u1@mail.example.org; \n" * 20_000
    began = time.time()
    got = spark.createDataFrame([(text,)], "x string").select(P.redact(F.col("x")).alias("x")).first()["x"]
    assert got == "[phone], [national_id], [email]; \n" * 20_000 and time.time() - began < 60


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
PHONES = [(1, "call 01012345678 or a.b@c.org", "en", "a", 1), (2, "id 29001011234567, السيد أحمد", "ar", "b", 1), (3, None, None, None, None), (4, "a@b.c+d@e.f ٠١٢@x.y", "en", "a", 1)]


@pytest.mark.parametrize("name", ["batch_redaction", "pii_findings"])
def test_texts_with_other_personal_data(same, name):
    """These queries are of addresses; a phone number, an id or a name in a text is not theirs."""
    assert same(name, documents=(PHONES, DOCUMENTS))


def test_tokens_cost_little_more_than_their_pattern(spark):
    """Folding looked at every character of texts that have nothing to fold, which took thrice the time of the words."""
    rows = spark.createDataFrame([("Élan der word, and so on. " * 40_000,)], "t string").crossJoin(spark.range(8)).cache()
    rows.count()

    def seconds(words) -> float:
        times = []
        for _ in range(3):
            began = time.time()
            rows.agg(F.sum(F.size(words))).collect()
            times.append(time.time() - began)
        return min(times)

    plain = F.regexp_extract_all(F.lower("t"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    assert seconds(T.tokens(F.col("t"))) < 2.5 * seconds(plain)


def test_dense_search_holds_scores_of_some_questions_at_a_time(spark):
    """Slices of a block's questions give what the whole block gives."""
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5) + 1, float(i % 3)]) for i in range(60)], "id long, vec array<double>")
    asked = rows.where("id % 4 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    one, many = (sorted(map(tuple, R.dense_search(asked, rows, k=5, at_once=n).collect())) for n in (1, 1000))
    assert one == many and len(one) == 75


def test_sections_leave_the_rows_in_the_jvm(spark):
    """A group of Python a document took most of the time."""
    rows = spark.createDataFrame([(1, 2, "end"), (1, 0, "a"), (1, 1, "x"), (1, 3, "y"), (1, 4, "t"), (2, 0, "b")], "doc long, line_no int, line string")
    out = O.cut_sections(rows, [("one", "^[Aa]"), ("two", "^[Ee]"), (None, "^[Tt]")])
    assert sorted(map(tuple, out.collect())) == [(1, "one", "x"), (1, "two", "y")]
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and "InPandas" not in out._jdf.queryExecution().executedPlan().toString()
