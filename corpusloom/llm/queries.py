"""One query for each operator over its whole table, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import ann, chatformat, divergence, dualtree, langid, license_scan, minhash, mixing, quality_clf, quality_rules, sentencepiece_tok, toxicity, url_filter
from corpusloom.llm.common import fold

#: Where the public tokenizers' files are.
TOKENIZERS = os.environ.get("CORPUSLOOM_TOKENIZERS", "/opt/tokenizers")
URL_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filter.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def predicted() -> F.Column:
    return F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted")


def held_out(folds: int, out: int) -> F.Column:
    return F.coalesce(fold(F.col("doc_id"), folds) == out, F.lit(False)).alias("held_out")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold(F.col("doc_id"), 4) != 2))
    return toxicity.score_texts(docs, model).select("doc_id", held_out(4, 2), "score", predicted())


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "reason")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(read(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 100 == 0)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_tok.encode_texts(docs, f"{TOKENIZERS}/piece_bpe_32k.model")
    digest = F.xxhash64("token_ids").alias("ids_hash")
    return coded.select("doc_id", "n_tokens", "n_byte_tokens", digest, "round_trip", "parity")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, docs.where("lang IS NOT NULL").where(fold(F.col("doc_id"), 4) != 2))
    return langid.label_texts(docs.select("doc_id", "text"), model).select("doc_id", held_out(4, 2), "lang_pred", "score")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    chats = chatformat.format_chats(chatformat.heterogeneous_records(chatformat.conversation_turns(rows), more=True))
    back, loss = chatformat.read_turns(F.col("formatted")), chatformat.loss_text(F.col("formatted"), F.col("loss_spans"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select("conv_id", "formatted", back.alias("turns"), loss.alias("loss")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    model = quality_clf.fit(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    return quality_clf.score_texts(docs, model).select("doc_id", held_out(5, 0), "score", predicted())


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "obligation")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(read(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dualtree.cluster_vectors(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), dim=64, clusters=8, rounds=10, seed=3)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_filters, op2_minhash_near_dedup, op3_toxicity, op4_quality_rules, op5_mixing, op6_nearest_neighbours, op7_sentencepiece, op8_language_id, op9_chat_formatting, op10_quality_classifier, op11_license_scans, op12_source_divergence, op13_centroid_clustering, pipeline)
}

def lloyd_sql(dim: int = 64, clusters: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """Every round as two steps: assign all vectors, then move the centroids to the floor of their means."""
    parts = [
        f"""v AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
            WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}
        )""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS c, x FROM v
            ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), x LIMIT {clusters})""",
    ]
    for i in range(rounds + 1):
        gap = "list_sum(list_transform(list_zip(v.x, k.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
        parts.append(f"a{i} AS MATERIALIZED (SELECT row, any_value(vec_id) AS vec_id, any_value(v.x) AS x, min((d, c)) AS best FROM (SELECT v.row, v.vec_id, v.x, k.c, {gap} AS d FROM v, c{i} k) v GROUP BY row)")
        if i < rounds:
            cell = f"SELECT best[2] AS c, unnest(range(1, {dim} + 1)) AS place, unnest(x) AS x FROM a{i}"
            floor = "(sum(x)::HUGEINT - ((sum(x)::HUGEINT % count(*)) + count(*)) % count(*)) // count(*)"
            mean = f"SELECT c, list(m ORDER BY place)::BIGINT[] AS x FROM (SELECT c, place, {floor} AS m FROM ({cell}) GROUP BY c, place) GROUP BY c"
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT k.c, coalesce(m.x, k.x) AS x FROM c{i} k LEFT JOIN ({mean}) m USING (c))")
    return f"""
        WITH {", ".join(parts)}
        SELECT a.vec_id, a.best[2]::INTEGER AS cluster, a.best[1]::BIGINT AS distance, sum(a.best[1]) OVER (PARTITION BY a.best[2])::BIGINT AS cluster_inertia,
            sum(a.best[1]) OVER ()::BIGINT AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} k ON k.c = a.best[2]"""


ORACLES = {
    "op1_url_filters": """
        WITH cut AS (
            SELECT page_id, regexp_extract(url, '^.*?://([^/?#]*)', 1, 's') AS h, regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS p FROM pages
        ), pages_ AS (SELECT page_id, translate(coalesce(h, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(p, '') AS path FROM cut),
        rules(r_host, r_path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        urls AS (SELECT DISTINCT host, path FROM pages_),
        best AS (
            SELECT host, path, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(verdict, length(r_host || r_path)) AS verdict
            FROM urls JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY host, path
        )
        SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM pages_ p LEFT JOIN best b ON p.host = b.host AND p.path = b.path""",
    "op5_mixing": """
        WITH d AS (SELECT doc_id, source, coalesce(md5(text), '') AS tie, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, 3 * source_size AS most FROM s),
        r AS (
            SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                / sum(weight) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM w
        ), open AS (SELECT rate FROM r WHERE rate * weight < most ORDER BY most / weight, source ASC NULLS LAST LIMIT 1),
        t AS (SELECT source, source_size, least(coalesce((SELECT rate FROM open), 0) * weight, most::DOUBLE) AS target FROM r),
        u AS (
            SELECT d.*, t.source_size, t.target, ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || tie), 1, 15))::BIGINT AS h,
                coalesce(round(least(t.target / nullif(t.source_size, 0), 3.0) * 16777216)::BIGINT, 0) AS units,
                ('0x' || substr(md5('0:' || coalesce(d.source, '')), 1, 15))::BIGINT >> 36 AS off
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        ), c AS (SELECT *, (off + coalesce(sum(units) OVER (PARTITION BY source ORDER BY size, h, doc_id, tie, units ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS low FROM u)
        SELECT doc_id, size, source_size, target, (size * (((low + units) >> 24) - (low >> 24)))::BIGINT AS taken FROM c""",
    "op9_chat_formatting": """
        WITH r AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), e AS (
            SELECT *, regexp_replace(text, '([<\\[])(\\\\*)(/?s>|</?SYS>>|/?INST\\]|\\|[A-Za-z_]+\\|>)', '\\1\\2\\\\\\3', 'g') AS body,
                regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '([<\\[])(\\\\*)(/?s>|</?SYS>>|/?INST\\]|\\|[A-Za-z_]+\\|>)', '\\1\\2\\\\\\3', 'g') AS head
            FROM r
        )
        SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(length(head) + length(body) + 24)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op12_source_divergence": """
        WITH d AS (
            SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents
        ), w AS (SELECT row, lang, source, unnest(words) AS term FROM d),
        vocabulary AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
        sized AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM vocabulary GROUP BY lang),
        found AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN vocabulary USING (lang, term) GROUP BY lang, source, term),
        grouped AS (SELECT g.lang, g.source, coalesce(sum(f.n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN found f USING (lang, source) GROUP BY g.lang, g.source),
        p AS (
            SELECT g.lang, g.source, t.term, coalesce(f.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(f.n, 0) + 5)) // (g.n + 5 * s.v) AS p, 1 + (1000000000::HUGEINT * (t.n + 5)) // (s.n + 5 * s.v) AS q
            FROM grouped g JOIN sized s USING (lang) JOIN vocabulary t USING (lang) LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = t.term
        ), pairs AS (
            SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
            FROM grouped a JOIN grouped b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
                LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY a.lang, a.source, b.source
        ), terms AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
        ranked AS (
            SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item COLLATE C)::INTEGER AS rank FROM pairs
            UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item COLLATE C)::INTEGER FROM terms
        ) SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50""",
    "op13_centroid_clustering": lloyd_sql(),
}
