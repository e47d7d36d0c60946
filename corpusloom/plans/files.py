"""Queries of files written and read again, counts on the way, runs, judges and calls that fail at times."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.functions import text as T
from corpusloom.operators import answering, corpus as C, monitor as M, quality as Q
from corpusloom.plans.common import Query, read
from corpusloom.sources import paged, records as S


def scratch(spark: SparkSession, name: str) -> str:
    return f"{S.scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def records_round_trip(spark, d):
    """Documents without their texts as header-checked records, read again."""
    rows, place = read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), scratch(spark, "records")
    S.write_records(rows, place, "document", key=["doc_id"])
    return S.read_records(spark, place, "document", rows.schema)


def lines_and_tables(spark, d):
    """Events as JSON lines and as a table of tabs, read again and joined; and a JSON document of their number."""
    rows, place = read(spark, d, "events").select("event_id", "event_type", "user_id"), scratch(spark, "lines")
    rows.select("event_id", "event_type").write.json(f"{place}/lines")
    S.write_tsv(rows.select("event_id", "user_id"), f"{place}/table", key=["event_id"])
    spark.createDataFrame([(S.metrics_json({"events": {"n": rows.count()}}),)], "value string").coalesce(1).write.text(f"{place}/metrics")
    listed = S.read_jsonl(spark, f"{place}/lines", rows.select("event_id", "event_type").schema)
    table = spark.read.schema("event_id long, user_id long").csv(f"{place}/table", sep="\t", header=True)
    n = S.read_json_document(spark, f"{place}/metrics", StructType.fromDDL("events struct<n:long>")).head()["events"]["n"]
    return listed.join(table, "event_id").select("event_id", "event_type", "user_id", F.lit(n).alias("n"))


def paged_events(spark, d):
    """Events behind a cursor, a page at a time, in partitions of about equal numbers of rows, whatever their types."""
    path = f"{d}/events.parquet"
    fetch = paged.parquet_pages(path, ["event_id", "event_type", "value"])
    spark.dataSource.register(paged.paged_source("paged_events", fetch, "event_id long, event_type string, value double"))
    parts = paged.parquet_parts(path, 4 * spark.sparkContext.defaultParallelism)
    rows = spark.read.format("paged_events").option("query", ",".join(parts)).load()
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("event_id").alias("last_id"))


def stage_runs(spark, d):
    """Stages with their metrics as rows of the runs table; one fails."""
    place = scratch(spark, "runs")
    for name in ("documents", "labels", "nothing"):
        try:
            with paged.stage_run(spark, place, name, {"table": name}) as metrics:
                metrics["rows"] = read(spark, d, name).count()
        except Exception:  # noqa: BLE001, S112 - the run's row tells
            continue
    runs = spark.read.schema(paged.RUNS).parquet(place)
    return runs.select("stage", "status", F.col("params.table").alias("table"), F.col("metrics.rows").alias("n"), (F.col("error").isNotNull()).alias("failed"))


def evidence(spark, d):
    """A report's table and summary, written and read again."""
    place = scratch(spark, "evidence")
    by_lang = read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    S.write_evidence({"by_lang": (by_lang, ["lang"])}, {"total": by_lang.agg(F.sum("n")).head()[0]}, place)
    total = S.read_json_document(spark, f"{place}/summary", StructType.fromDDL("total long")).head()["total"]
    return spark.read.schema("lang string, n long, chars long").csv(f"{place}/by_lang", sep="\t", header=True).select("lang", "n", "chars", F.lit(total).alias("total"))


def judged_replies(spark, d):
    """A judge's replies about events: a number for most, none for errors, out of range for some."""
    reply = F.when(F.col("event_type") == "error", F.concat(F.lit("sorry, "), "props")).otherwise(F.concat(F.lit('{"faithfulness": '), F.round(F.col("value") / 50, 6).cast("string"), F.lit(', "precision": "high"}')))
    return Q.judged(read(spark, d, "events").where("value IS NOT NULL").select("event_id", reply.alias("reply")), "reply", ["faithfulness", "precision"]).select("event_id", "faithfulness", "precision")


def settings_checks(spark, d):
    """Paths of pages as settings: some are absolute, some climb out, others are blank."""
    path = F.regexp_extract("url", r"^[^:]*://[^/]*/?([^?#]*)", 1)
    value = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("/"), path)).when(F.col("page_id") % 5 == 1, F.concat(F.lit("a/../"), path)).when(F.col("page_id") % 5 == 2, F.lit(" ")).otherwise(F.concat(F.lit("data/"), path))
    kind = F.when(F.col("page_id") % 5 == 2, "text").when(F.col("page_id") % 5 == 3, "colour").otherwise("path")
    return Q.setting_problems(read(spark, d, "pages").select(F.col("page_id").alias("name"), kind.alias("kind"), value.alias("value"))).select(F.col("name").alias("page_id"), "problem")


def header_digits(spark, d):
    """Article headers of the documents' numbers, and what is none."""
    number = T.arabic_digits(F.col("doc_id"))
    header = F.when(F.col("doc_id") % 3 < 2, F.concat(F.lit("مادة "), number)).otherwise(F.concat(F.lit("مادة "), number, F.lit(" مكرر")))
    return read(spark, d, "documents").select("doc_id", C.digits_of_header(header).alias("number"))


def observed_metrics(spark, d):
    """Events' metrics as an observation gets them while the rows are read."""
    seen = Observation()
    rows = M.observed(read(spark, d, "events").select("event_id", "value"), seen, n=F.count("*"), with_value=F.count("value"), top=F.max("event_id"))
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["n"], seen.get["with_value"], seen.get["top"])], "n long, with_value long, top long")


def extracted_rows(spark, d):
    """Documents' lines as extracted rows, with counts taken while they are written: one pass."""
    line = F.col("line")
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    place = scratch(spark, "rows")
    found = Q.written_with_counts(
        rows, place,
        {"rows": F.count("*"), "first": F.count_if(F.col("at") == 0), "blank": F.count_if(F.trim(line) == ""), "capital": F.count_if(line.rlike("^[A-Z]")), "digits": F.count_if(line.rlike("[0-9]")), "chars": F.coalesce(F.sum(F.length(line)), F.lit(0)), "longest": F.coalesce(F.max(F.length(line)), F.lit(0))},
        {"rows": (0, float("inf"))},
    )
    stored = spark.read.schema(rows.schema).parquet(place).agg(F.count("*").alias("stored"))
    return stored.select(*[F.lit(v).cast("long").alias(n) for n, v in found.items()], "stored")


def retried_answers(spark, d):
    """Every benchmark item answered by a service that fails on each first call of a worker, from a memo on the second run."""
    rows, place = read(spark, d, "benchmark").select("item_id", "text"), scratch(spark, "memo")

    def call(question, seen={}):  # noqa: B006 - a worker's memory
        seen[question] = seen.get(question, 0) + 1
        if seen[question] == 1 and len(seen) == 1:
            raise ConnectionError("busy")
        return hashlib.md5(question.encode(), usedforsecurity=False).hexdigest()

    def never(question):
        raise AssertionError(question)

    answering.answer_all(rows, call, place, key="item_id", question="text", waits=(0.01,), buckets=8)
    again = answering.answer_all(rows, never, place, key="item_id", question="text", waits=(), buckets=8)
    return again.select(F.col("key").cast("long").alias("item_id"), "answer")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (records_round_trip, lines_and_tables, paged_events, stage_runs, evidence, judged_replies, settings_checks, header_digits, observed_metrics, extracted_rows, retried_answers)
}

ORACLES: dict[str, str] = {
    "records_round_trip": "SELECT doc_id, lang, source, n_chars FROM documents",
    "lines_and_tables": "SELECT event_id, event_type, user_id, count(*) OVER () AS n FROM events",
    "paged_events": "SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total, max(event_id) AS last_id FROM events GROUP BY event_type",
    "stage_runs": """SELECT 'documents' AS stage, 'FINISHED' AS status, 'documents' AS "table", count(*)::DOUBLE AS n, false AS failed FROM documents
        UNION ALL SELECT 'labels', 'FINISHED', 'labels', count(*)::DOUBLE, false FROM labels UNION ALL SELECT 'nothing', 'FAILED', 'nothing', NULL, true""",
    "evidence": "SELECT lang, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars, (SELECT count(*) FROM documents)::BIGINT AS total FROM documents GROUP BY lang",
    "judged_replies": """SELECT event_id, CASE WHEN event_type <> 'error' AND round(value / 50, 6) BETWEEN 0 AND 1 THEN round(value / 50, 6) END AS faithfulness, NULL::DOUBLE AS precision FROM events WHERE value IS NOT NULL""",
    "settings_checks": """SELECT page_id, CASE WHEN page_id % 5 = 2 THEN 'no text' WHEN page_id % 5 = 3 THEN 'unknown kind' ELSE 'no path' END AS problem FROM pages WHERE page_id % 5 < 4""",
    "header_digits": "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN doc_id::INTEGER END AS number FROM documents",
    "observed_metrics": "SELECT count(*)::BIGINT AS n, count(value)::BIGINT AS with_value, max(event_id) AS top FROM events",
    "extracted_rows": """WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
        SELECT count(*)::BIGINT AS rows, (SELECT count(text) FROM documents)::BIGINT AS first, count(*) FILTER (trim(line) = '')::BIGINT AS blank, count(*) FILTER (regexp_matches(line, '^[A-Z]'))::BIGINT AS capital,
            count(*) FILTER (regexp_matches(line, '[0-9]'))::BIGINT AS digits, coalesce(sum(length(line)), 0)::BIGINT AS chars, coalesce(max(length(line)), 0)::BIGINT AS longest, count(*)::BIGINT AS stored FROM l""",
    "retried_answers": "SELECT item_id, md5(text) AS answer FROM benchmark",
}
