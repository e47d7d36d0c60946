import pytest

from corpusloom.schemas import DDL, fingerprint, schema
from corpusloom.sources import records as S


def test_records_round_trip_and_header(spark, tmp_path):
    fields = "id int, text string, n array<int>"
    df = spark.createDataFrame([(2, "b\nc", None), (1, "أ", [1, 2])], fields)
    S.write_records(df, f"{tmp_path}/r", "thing", key=["id"])
    back = S.read_records(spark, f"{tmp_path}/r", "thing", df.schema)
    assert [tuple(r) for r in back.orderBy("id").collect()] == [(1, "أ", [1, 2]), (2, "b\nc", None)]
    with pytest.raises(S.SchemaMismatch):
        S.read_records(spark, f"{tmp_path}/r", "other", df.schema)
    with pytest.raises(S.SchemaMismatch):
        S.read_records(spark, f"{tmp_path}/r", "thing", spark.createDataFrame([], "id int").schema)


def test_records_in_one_file_and_fields_like_a_header(spark, tmp_path):
    df = spark.createDataFrame([("m", "s", 1), ("other", "x", 2)], "model string, schema string, n int")
    for single in (False, True):
        S.write_records(df, f"{tmp_path}/{single}", "thing", key=["n"], single_file=single)
        assert [r["n"] for r in S.read_records(spark, f"{tmp_path}/{single}", "thing", df.schema).orderBy("n").collect()] == [1, 2]
    S.write_records(df.limit(0), f"{tmp_path}/none", "thing")
    assert S.read_records(spark, f"{tmp_path}/none", "thing", df.schema).count() == 0
    files = list(tmp_path.glob("True/part-*"))
    assert len(files) == 1 and files[0].read_text().startswith('{"model": "thing"')


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        S.scratch_dir(Session)


def test_fingerprints_differ(spark):
    assert len({fingerprint(schema(n)) for n in DDL}) == len(DDL)


def test_errata_file(spark):
    text = "- {page: 1, row: 2, side: ar, expect: a, replace: b, reason: x}\n"
    assert [tuple(r) for r in S.read_errata(spark, text).collect()] == [(0, 1, 2, "ar", "a", "b")]
    assert S.read_errata(spark, "").count() == 0


def test_flatten():
    assert S.flatten({"a": {"b": 1, "c": True, "d": {"e": 0.5}}, "f": "x"}) == {"a.b": 1.0, "a.d.e": 0.5}


def test_indexed_table_guard(spark, tmp_path):
    df = spark.createDataFrame([("c1", [0.5])], "chunk_id string, vec array<double>")
    S.write_indexed(df, f"{tmp_path}/i", {"model": "m", "n": 1})
    assert S.open_indexed(spark, f"{tmp_path}/i", {"model": "m"}).count() == 1
    with pytest.raises(S.SchemaMismatch, match="model"):
        S.open_indexed(spark, f"{tmp_path}/i", {"model": "x"})


def test_tsv(spark, tmp_path):
    S.write_tsv(spark.createDataFrame([(2, "b"), (1, "a")], "id int, t string"), f"{tmp_path}/t", key=["id"], single_file=True)
    text = next(tmp_path.glob("t/part-*")).read_text()
    assert text == "id\tt\n1\ta\n2\tb\n"
