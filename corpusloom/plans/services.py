"""Queries of versions, exactly-once streams, table functions, training, subwords and ruled tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import subwords, tables, text as T
from corpusloom.functions.vectors import logit
from corpusloom.operators import cells as C, retrieval as R, student as L
from corpusloom.plans.common import Query, long, read, spread
from corpusloom.plans.monitoring import state_store, streamed
from corpusloom.plans.retrieval import RERANKED, reranked
from corpusloom.plans.text import TOKENS
from corpusloom.sources.records import scratch_dir
from corpusloom.sources.registry import NotPromoted, Registry
from corpusloom.sources.scores import Scores, read_scores
from corpusloom.streaming import answers, readings, scoring

PERIOD, PICKED, LATE = 6 * 3600, 5, 1800


def scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def registry_versions(spark, d):
    """Three versions of the documents' counts by source: the second covers more and is promoted, the third covers less and is not."""
    docs, registry = read(spark, d, "documents"), Registry(spark, scratch(spark, "registry"))
    for name, where in (("en", "lang = 'en'"), ("all", "true"), ("not en", "lang <> 'en'")):
        rows = docs.where(where).groupBy("source").agg(F.count("*").alias("n"))
        covered = docs.where(where).count()
        registry.commit(rows, base=registry.latest() or None, tags={"rows": name}, metrics={"covered": covered})
        try:
            registry.promote("covered")
        except NotPromoted:
            continue
    shown = registry.open("champion").select("source", "n", F.lit(registry.named("champion")).alias("champion"), F.lit(registry.named("candidate")).alias("candidate"))
    return shown.join(registry.open("candidate").select("source", F.col("n").alias("candidate_n")), "source", "left")


def judged(p: pd.DataFrame) -> pd.Series:
    """A judge without a model: smaller latencies score higher."""
    return (1 / (1 + p["value"])).round(9)


def scored_periods(spark, d):
    """Of every six hours five answered requests, scored once the period is over and written by the exactly-once sink."""
    place = scratch(spark, "scores")
    rows = read(spark, d, "events").where("event_type <> 'error' AND value IS NOT NULL").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    rows.write.parquet(f"{place}/in")
    found = spark.readStream.schema(rows.schema).parquet(f"{place}/in")
    out = scoring.scored(scoring.sampled_periods(found, ts="ts", id="event_id", seconds=PERIOD, n=PICKED, late=f"{LATE} seconds", seed="s1"), judged)
    spark.dataSource.register(Scores)
    with state_store(spark):
        out.writeStream.format("scores").option("path", f"{place}/out").option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start().awaitTermination()
    return read_scores(spark, f"{place}/out", out.schema).select("period", "event_id", "score")


def stream_readings(spark, d):
    """Purchases and clicks of one user within a quarter of an hour, joined as streams."""
    rows = read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")

    def joined(events):
        side = lambda kind: events.where(F.col("event_type") == kind).select("user_id", "ts", "event_id")
        return readings.joined_readings(side("purchase"), side("click"), on=["user_id"], seconds=900, late="1 hour")

    return streamed(rows, joined).select(F.col("event_id").alias("purchase"), F.col("right_event_id").alias("click"))


def stream_answers(spark, d):
    """Conversations as answers in pieces: one that ends with an assistant's turn is final, another is closed by its timer."""
    rows = read(spark, d, "conversations")
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))) == 1
    pieces = rows.select(
        F.col("conv_id").alias("key"), F.col("turn").cast("long").alias("seq"), F.col("text").alias("piece"), (last & (F.col("role") == "assistant")).alias("last"), F.timestamp_seconds(1_000_000 + F.col("conv_id") * 60 + F.col("turn")).alias("ts")
    )
    out = streamed(pieces, lambda p: answers.answer_stream(p, idle_ms=60_000, ts="ts")).where("kind <> 'piece'")
    return out.select("key", "kind", "pieces", F.md5(F.col("text").cast("binary")).alias("digest"))


def sql_chunks(spark, d):
    """Lines of documents to chunks of up to 800 characters, by the table function."""
    tables.register(spark)
    read(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("at", "text")).createOrReplaceTempView("document_lines")
    chunks = spark.sql("SELECT * FROM chunk_parts(TABLE(document_lines) PARTITION BY (doc) ORDER BY (at), 800)")
    return chunks.select("doc", "part", "first", "paragraphs", F.md5(F.col("text").cast("binary")).alias("digest"))


def label_centroids(spark, d):
    """The mean vector of each label, by the SQL aggregate."""
    out = tables.centroids(spark, read(spark, d, "embeddings"), by="label", vector="embedding", salt="vec_id")
    return out.select("label", "n", *[F.round(F.col("centroid")[i], 6).alias(f"c{i}") for i in (0, 1, 63)])


def student_weights(spark, d):
    """A student of three features on the reranker's logits, ten rounds over all pairs."""
    p = F.least(F.greatest(F.col("rerank"), F.lit(1e-6)), F.lit(1 - 1e-6))
    rows = reranked(spark, d).where("rerank IS NOT NULL").select(F.array(F.lit(1.0), F.col("rrf") * 10, 1 / F.col("rank")).alias("x"), logit(p).alias("y"))
    place = scratch(spark, "pairs")
    rows.write.parquet(place)
    weights, losses = L.train_student(spark.read.schema(rows.schema).parquet(place), rounds=10, rate=0.2)
    return spark.createDataFrame([(i, round(w, 6), round(losses[-1], 6)) for i, w in enumerate(weights)], "feature int, weight double, loss double")


def subword_counts(spark, d):
    """Pieces of the documents' words: the vocabulary is the benchmark's 3,000 commonest words, as starts and as rests, and all its letters."""
    words = read(spark, d, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("w"))
    common = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(3000).select("w")
    letters = words.select(F.explode(F.split("w", "")).alias("c")).where("c <> ''").distinct()
    starts = common.select("w").union(letters)
    vocabulary = starts.union(starts.select(F.concat(F.lit("##"), "w"))).distinct().collect()  # 6,000 pieces and two for a letter
    cut = subwords.subword_tokens(sorted(r["w"] for r in vocabulary), inner="##")
    counted = spread(read(spark, d, "documents")).select(F.explode(T.tokens(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return counted.select("n", F.explode(cut(F.array("w"))).alias("piece")).groupBy("piece").agg(F.sum("n").alias("n"))  # a word is cut once


def ruled_rows(spark, d):
    """Documents as ruled pages: a row a line, words at places by their hash, stray lines in every third row, no right side in every fifth."""
    rows = spread(read(spark, d, "documents").select(F.col("doc_id").alias("page"), "text")).select("page", F.posexplode(F.split("text", "\n", -1)).alias("r", "line"))
    top = (F.col("r") * 20).cast("double")
    line = lambda x0, y0, x1, y1: F.struct(*[v.cast("double").alias(n) for v, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))])
    flat = [line(F.lit(0), y, F.lit(600), y) for y in (top, top + 20)]
    upright = lambda x: line(F.lit(x), top, F.lit(x), top + 20)
    drawn = F.array(*flat, upright(0), upright(300), F.when(F.col("r") % 5 != 4, upright(600)), F.when(F.col("r") % 3 == 1, upright(150)))
    lines = rows.select("page", F.inline(F.filter(drawn, lambda x: x.isNotNull())))
    words = rows.select("page", "r", F.explode(F.regexp_extract_all("line", F.lit("[^ ]+"), F.lit(0))).alias("text"))
    place = F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 7), 16, 10).cast("long") % 590 + 5
    glyphs = words.select("page", place.cast("double").alias("x"), (F.col("r") * 20.0 + 10).alias("y"), "text")
    digest = lambda c: F.md5(F.col(c).cast("binary")).alias(c)
    return C.row_texts(lines, glyphs).select("page", "table", "row", "last", digest("left"), digest("right"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (registry_versions, scored_periods, stream_readings, stream_answers, sql_chunks, label_centroids, student_weights, subword_counts, ruled_rows)
}

ORACLES: dict[str, str] = {
    "registry_versions": """WITH c AS (SELECT source, count(*)::BIGINT AS n, count(*) FILTER (lang <> 'en')::BIGINT AS rest FROM documents GROUP BY source)
        SELECT source, n, 2 AS champion, 3 AS candidate, nullif(rest, 0) AS candidate_n FROM c""",
    "scored_periods": f"""WITH a AS (SELECT event_id, ts, value, floor(epoch(ts) / {PERIOD})::BIGINT * {PERIOD} AS period FROM events WHERE event_type <> 'error' AND value IS NOT NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY md5('s1:' || event_id), event_id::VARCHAR) AS k, max(epoch(ts)) OVER () - {LATE} AS mark FROM a)
        SELECT period, event_id, round(1 / (1 + value), 9) AS score FROM r WHERE k <= {PICKED} AND period + {PERIOD} <= mark""",
    "stream_readings": """SELECT p.event_id AS purchase, c.event_id AS click FROM events p JOIN events c ON p.user_id = c.user_id AND p.event_type = 'purchase' AND c.event_type = 'click'
        AND c.ts BETWEEN p.ts - INTERVAL 900 SECONDS AND p.ts + INTERVAL 900 SECONDS""",
    "stream_answers": """WITH c AS (SELECT conv_id AS key, count(*)::BIGINT AS pieces, string_agg(coalesce(text, ''), '' ORDER BY turn) AS t, arg_max(role, turn) AS ended, conv_id * 60 + max(turn) AS ts FROM conversations GROUP BY conv_id)
        SELECT key, CASE WHEN ended = 'assistant' THEN 'final' ELSE 'stalled' END AS kind, pieces, md5(t) AS digest FROM c WHERE ended = 'assistant' OR ts + 60 <= (SELECT max(conv_id * 60 + turn) FROM conversations)""",
    "sql_chunks": """WITH RECURSIVE l AS (SELECT doc_id AS doc, string_split(text, chr(10)) AS w FROM documents WHERE text IS NOT NULL),
        s AS (
            SELECT doc, w, 1 AS i, 1 AS part, length(w[1]) AS chars FROM l
            UNION ALL SELECT doc, w, i + 1, CASE WHEN chars + 1 + length(w[i + 1]) > 800 THEN part + 1 ELSE part END, CASE WHEN chars + 1 + length(w[i + 1]) > 800 THEN length(w[i + 1]) ELSE chars + 1 + length(w[i + 1]) END FROM s WHERE i < len(w)
        ) SELECT doc, part::INT AS part, (min(i) - 1)::INT AS first, count(*)::INT AS paragraphs, md5(string_agg(w[i], chr(10) ORDER BY i)) AS digest FROM s GROUP BY doc, part""",
    "label_centroids": """SELECT label, count(*)::BIGINT AS n, round(avg(embedding[1]::DOUBLE), 6) AS c0, round(avg(embedding[2]::DOUBLE), 6) AS c1, round(avg(embedding[64]::DOUBLE), 6) AS c63
        FROM embeddings WHERE embedding IS NOT NULL GROUP BY label""",
    "student_weights": f"""WITH RECURSIVE {RERANKED}, x AS (SELECT rrf * 10 AS a, 1.0::DOUBLE / rank AS b, ln(p / (1 - p)) AS y FROM (SELECT *, least(greatest(rerank, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS p FROM reranked)),
        s AS (SELECT count(*)::DOUBLE AS n, sum(a) AS sa, sum(b) AS sb, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(y) AS y, sum(a * y) AS ay, sum(b * y) AS by_, sum(y * y) AS yy FROM x),
        w AS (
            SELECT 0 AS i, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS loss
            UNION ALL SELECT i + 1, w0 - 0.4::DOUBLE / n * (n * w0 + sa * w1 + sb * w2 - y), w1 - 0.4::DOUBLE / n * (sa * w0 + aa * w1 + ab * w2 - ay), w2 - 0.4::DOUBLE / n * (sb * w0 + ab * w1 + bb * w2 - by_),
                (yy - 2 * (w0 * y + w1 * ay + w2 * by_) + n * w0 * w0 + aa * w1 * w1 + bb * w2 * w2 + 2 * (sa * w0 * w1 + sb * w0 * w2 + ab * w1 * w2)) / n FROM w, s WHERE i < 10
        ) SELECT unnest([0, 1, 2])::INT AS feature, unnest([round(w0, 6), round(w1, 6), round(w2, 6)]) AS weight, round(loss, 6) AS loss FROM w WHERE i = 10""",
    "subword_counts": f"""WITH RECURSIVE b AS (SELECT unnest({TOKENS}) AS w FROM benchmark), common AS (SELECT w FROM (SELECT w, count(*) AS n FROM b GROUP BY w ORDER BY n DESC, w LIMIT 3000)),
        v AS (SELECT w FROM common UNION SELECT unnest(string_split(w, '')) FROM b), most AS (SELECT max(length(w)) AS n FROM v),
        words AS (SELECT w, count(*) AS n FROM (SELECT unnest({TOKENS}) AS w FROM documents) GROUP BY w),
        cut AS (
            SELECT w, 0 AS pos, 0 AS k, NULL::VARCHAR AS piece FROM words
            UNION ALL
            SELECT w, pos + length(p), k + 1, p FROM (
                SELECT c.w, c.pos, c.k, (SELECT arg_max(v.w, length(v.w)) FROM v WHERE length(v.w) > 0 AND v.w = substr(c.w, c.pos + 1, length(v.w))) AS p FROM cut c WHERE c.pos < length(c.w)
            ) WHERE p IS NOT NULL
        ), done AS (SELECT w, max(pos) AS pos FROM cut GROUP BY w),
        pieces AS (
            SELECT CASE WHEN k = 1 THEN piece ELSE '##' || piece END AS piece, n FROM cut JOIN done USING (w) JOIN words USING (w) WHERE k > 0 AND done.pos = length(w) AND length(w) <= 100
            UNION ALL SELECT '[UNK]', n FROM done JOIN words USING (w) WHERE done.pos < length(w) OR length(w) > 100
        ) SELECT piece, sum(n)::BIGINT AS n FROM pieces GROUP BY piece""",
    "ruled_rows": """WITH l AS (SELECT page, unnest(ls) AS line, unnest(range(len(ls)))::INT AS r, len(ls) - 1 AS z FROM (SELECT doc_id AS page, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
        g AS (SELECT *, list_sort(list_transform(regexp_extract_all(line, '[^ ]+'), lambda t: {'x': ('0x' || substr(md5(t), 1, 7))::BIGINT % 590 + 5, 't': t})) AS s FROM l)
        SELECT page, 0 AS table, r AS row, r = z AS last, md5(coalesce(array_to_string(list_transform(list_filter(s, lambda p: p.x < 300), lambda p: p.t), ' '), '')) AS left,
            CASE WHEN r % 5 <> 4 THEN md5(coalesce(array_to_string(list_transform(list_filter(s, lambda p: p.x >= 300), lambda p: p.t), ' '), '')) END AS right FROM g""",
}
