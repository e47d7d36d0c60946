"""Queries of record-level operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import headings as H, records as O, retrieval as R
from corpusloom.plans.common import Query, long, read, spread, values_sql
from corpusloom.plans.monitoring import streamed
from corpusloom.plans.retrieval import ORACLES as RETRIEVAL_ORACLES, TOP, indexed, questions
from corpusloom.sources import records as S
from corpusloom.streaming import processors as P

def articles_of_texts(spark, d):
    rows = read(spark, d, "documents").select(F.xxhash64("text").alias("h"), F.md5(F.col("text").cast("binary")).alias("digest"), "doc_id")
    out = O.articles_of_texts(rows, "digest", "doc_id")
    return out.where(F.size("articles") > 1).select("digest", F.array_join(F.col("articles").cast("array<string>"), ",").alias("articles"))


def common_first_words(spark, d):
    rows = read(spark, d, "documents").select(F.substring_index("text", " ", 1).alias("word"), F.col("doc_id").alias("pos"))
    return O.most_common(rows, "word", 15)


def header_shapes(spark, d):
    rows = read(spark, d, "pages").select(O.header_shape(F.regexp_extract("url", r"^[^?#]*", 0)).alias("shape"))
    return rows.groupBy("shape").agg(F.count("*").alias("n")).where("n > 2")


def corpus_digest(spark, d):
    rows = read(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return O.set_digest(rows, "id", F.sha2(F.col("text").cast("binary"), 256))


def lowest_scores(spark, d):
    rows = read(spark, d, "events").select("event_id", F.round("value", 6).alias("value"))
    return O.lowest(rows, "value", "event_id", 10)


def rendered_contexts(spark, d):
    rows = read(spark, d, "documents")
    return rows.select("doc_id", F.md5(O.render_context(F.col("lang"), F.col("text"), F.lit(""), F.col("doc_id")).cast("binary")).alias("digest"))


def filled_prompts(spark, d):
    rows = read(spark, d, "benchmark").select("item_id", F.lit("Question: {question} in {language}").alias("t"), F.col("text").alias("q"))
    return rows.select("item_id", O.fill_template(F.col("t"), {"question": F.col("q"), "language": F.lit("English")}).alias("prompt"))


def picked_articles(spark, d):
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("article_number"), F.col("text").alias("text_ar"), F.col("source").alias("text_en"), (F.col("lang") == "de").alias("is_repealed"))
    return O.pick_articles(rows, exclude=read(spark, d, "labels").select(F.col("doc_id").alias("article_number")), n=15).select("article_number")


def index_round_trip(spark, d):
    """The token index written as a table with its manifest, opened again under the guard, and searched."""
    place, manifest = f"{S.scratch_dir(spark)}/index-{uuid.uuid4().hex}", {"tokenizer": "words", "stopwords": "none", "k1": R.K1, "b": R.B}
    S.write_indexed(indexed(spark, d), place, manifest)
    opened = S.open_indexed(spark, place, {"tokenizer": "words", "stopwords": "none"})
    return R.bm25_search(questions(spark, d), opened, k=TOP).select("qid", "id", "score", long("rank"))


def stream_rates(spark, d):
    """Windows that the watermark closed while the stream ran; late windows stay open at the end of a finite table."""
    rows = read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return streamed(rows, P.rate_stream).select("event_type", "window_start", F.round("rate", 9).alias("rate"))


def long_lines(spark, d):
    rows = spread(read(spark, d, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.length(x) > 400).alias("l")).where(F.size("l") > 0).select("doc_id", F.size("l").cast("long").alias("n"))


def kept_passages(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("p"), F.replace("text", F.lit(" the "), F.lit(" ")).alias("part"))
    return rows.select("doc_id", F.size(O.passages_within(F.col("p"), F.col("part"))).cast("long").alias("n"))


def over_length(spark, d):
    rows = spread(read(spark, d, "documents").select("doc_id", "text"))
    n = F.size(T.tokens(F.col("text")))
    return O.over_limit(rows, n, 512).select("doc_id", n.cast("long").alias("n_tokens"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        articles_of_texts, common_first_words, header_shapes, corpus_digest, lowest_scores, rendered_contexts, filled_prompts,         picked_articles, index_round_trip, stream_rates,
        long_lines, kept_passages, over_length,
    )
}

AR_ID = "translate(doc_id::VARCHAR, '0123456789', '٠١٢٣٤٥٦٧٨٩')"
ORACLES: dict[str, str] = {
    "articles_of_texts": "SELECT md5(text) AS digest, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS articles FROM documents GROUP BY text HAVING count(*) > 1",
    "common_first_words": "SELECT string_split(text, ' ')[1] AS word, count(*)::BIGINT AS n, min(doc_id) AS first_seen FROM documents GROUP BY word ORDER BY n DESC, first_seen LIMIT 15",
    "header_shapes": "SELECT regexp_replace(regexp_extract(url, '^[^?#]*'), '[0-9٠-٩]+', 'N', 'g') AS shape, count(*)::BIGINT AS n FROM pages GROUP BY shape HAVING count(*) > 2",
    "corpus_digest": "SELECT sha256(string_agg(sha256(text), '' ORDER BY item_id)) AS digest FROM benchmark",
    "lowest_scores": "SELECT event_id, round(value, 6) AS value FROM events WHERE value IS NOT NULL ORDER BY round(value, 6), event_id LIMIT 10",
    "rendered_contexts": f"SELECT doc_id, md5('## Article ' || doc_id || ' | المادة ' || {AR_ID} || chr(10) || chr(10) || lang || chr(10) || chr(10) || text) AS digest FROM documents",
    "filled_prompts": "SELECT item_id, 'Question: ' || text || ' in English' AS prompt FROM benchmark",
    "picked_articles": """SELECT doc_id AS article_number FROM documents WHERE lang <> 'de' AND trim(text) <> '' AND trim(source) <> '' AND doc_id NOT IN (SELECT doc_id FROM labels)
        ORDER BY md5('0:' || doc_id), doc_id LIMIT 15""",
    "index_round_trip": RETRIEVAL_ORACLES["bm25_topk"],
    "stream_rates": """WITH r AS (SELECT event_type, unnest(generate_series(time_bucket(INTERVAL 1 MINUTE, ts) - INTERVAL 4 MINUTE, time_bucket(INTERVAL 1 MINUTE, ts), INTERVAL 1 MINUTE)) AS window_start FROM events)
        SELECT event_type, window_start, round(count(*) / 300.0::DOUBLE, 9) AS rate FROM r WHERE window_start + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 5 MINUTE GROUP BY event_type, window_start""",
    "long_lines": "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 400))::BIGINT AS n FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 400)) > 0",
    "kept_passages": "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: contains(replace(text, ' the ', ' '), x)))::BIGINT AS n FROM documents",
    "over_length": "WITH t AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))::BIGINT AS n_tokens FROM documents) SELECT * FROM t WHERE n_tokens > 512",
}
