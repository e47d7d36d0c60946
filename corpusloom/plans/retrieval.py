"""Queries of retrieval, evaluation and comparison operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import evaluate as E, retrieval as R
from corpusloom.plans.common import Query, file_states, long, read, spread, values_sql
from corpusloom.plans.text import LUCENE, TOKENS
from corpusloom.sources import records as S

TOP, HEAD = 10, 5


def questions(spark: SparkSession, d: str, stopwords: str = "none") -> DataFrame:
    """The tokens of each benchmark item, all of them."""
    return read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), T.search_tokens(F.col("text"), stopwords=stopwords).alias("words"))


MANIFEST = {"tokenizer": "words", "stopwords": "none"}
_STORED: dict[tuple, str] = {}


def indexed(spark: SparkSession, d: str, stopwords: str = "none") -> DataFrame:
    """The token index of the documents, tokenised and written once a session for a state of the files; lists with stopwords are cut from it."""
    table = read(spark, d, "documents").select("doc_id", "text")
    key = (spark.sparkContext.applicationId, d, *file_states(spark, table))
    if key not in _STORED or not S.exists(spark, f"{_STORED[key]}/manifest"):
        place = f"{S.scratch_dir(spark)}/token-index-{uuid.uuid4().hex}"
        S.write_indexed(R.token_index(spread(table), T.tokens(F.col("text")), id="doc_id"), place, MANIFEST)
        _STORED[key] = place
    return R.without_terms(S.open_indexed(spark, _STORED[key], MANIFEST), T.STOPWORDS[stopwords])


def token_index(spark, d):
    """The index itself: tokens and distinct terms of each document, as it is made before it is stored."""
    index = R.token_index(spread(read(spark, d, "documents").select("doc_id", "text")), T.tokens(F.col("text")), id="doc_id")
    return index.select(F.col("id").alias("doc_id"), long("dl"), F.size("terms").cast("long").alias("n_terms"))


def bm25(spark: SparkSession, d: str, *, stopwords: str = "none", b: float = R.B, k: int = TOP) -> DataFrame:
    # no question asks for a stopword, and without b no length counts: then the index serves as it is
    return R.bm25_search(questions(spark, d, stopwords), indexed(spark, d, stopwords if b else "none"), k=k, b=b)


def expected(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a benchmark item's whole text.

    A document that holds a text holds its inner tokens, so candidates come from an equi-join on the longest of
    them, not from all pairs. Items without an inner token, of one or two tokens, meet documents by their first
    three characters (or what they have of them).
    """
    words = T.tokens(F.col("text"))
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    items = read(spark, d, "benchmark").where("text <> ''").select(F.col("item_id").alias("qid"), F.col("text").alias("needle"), longest.alias("h"))
    docs = spread(read(spark, d, "documents").select("doc_id", "text"))
    held = indexed(spark, d).select(F.col("id").alias("doc_id"), F.explode("terms.term").alias("h"))
    pairs = held.join(items.where("h IS NOT NULL"), "h").select("qid", "needle", "doc_id")
    short = items.where("h IS NULL").select("qid", "needle", F.substring("needle", 1, 3).alias("h"))
    if not short.isEmpty():
        sizes = [r["n"] for r in short.select(F.length("h").alias("n")).distinct().collect()]  # three numbers at most
        starts = F.when(F.length("text") > 0, F.sequence(F.lit(1), F.length("text"))).otherwise(F.array().cast("array<int>"))
        grams = [gram(starts, n) for n in sizes]
        pairs = pairs.unionByName(docs.select("doc_id", F.explode(F.array_distinct(F.flatten(F.array(*grams)))).alias("h")).join(short, "h").select("qid", "needle", "doc_id"))
    return pairs.join(docs, "doc_id").where(F.col("text").contains(F.col("needle"))).select("qid", F.col("doc_id").alias("id")).distinct()


def gram(starts: F.Column, n: int) -> F.Column:
    """A text's pieces of n characters."""
    return F.transform(starts, lambda i: F.substr(F.col("text"), i, F.lit(n)))


def bm25_stats(spark, d):
    index = indexed(spark, d)
    stats = R.corpus_stats(index).select("n_docs", F.round("avg_len", 6).alias("avg_len"), "max_len", "n_empty")
    return stats.crossJoin(R.postings(index).agg(F.count_distinct("term").alias("vocabulary")))


def bm25_weights(spark, d):
    index = indexed(spark, d)
    w = R.bm25_weights(R.postings(index), R.corpus_stats(index))
    return w.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n_terms"), F.round(F.sum("weight"), 6).alias("weight"), F.round(F.max("weight"), 6).alias("heaviest"))


def bm25_topk(spark, d):
    return bm25(spark, d).select("qid", "id", "score", long("rank"))


def vectors(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, d, "embeddings")
    return rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), F.col("label").alias("qlabel")), rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def dense(spark, d, k: int = TOP) -> DataFrame:
    asked, rows = vectors(spark, d)
    return R.dense_search(asked.select("qid", "qvec"), rows, k=k)


def dense_topk(spark, d):
    return dense(spark, d).select("qid", "id", F.round("score", 6).alias("score"), long("rank"))


def fused(spark, d) -> DataFrame:
    return R.rrf([bm25(spark, d), bm25(spark, d, stopwords="lucene", b=0.0)], scores=["bm25", "flat"])


def rrf_fusion(spark, d):
    return fused(spark, d).select("qid", "id", F.round("rrf", 9).alias("rrf"), long("rank"))


def reranked(spark, d) -> DataFrame:
    terms = indexed(spark, d).select("id", F.col("terms.term").alias("terms"))  # tokenised before
    head, asked = fused(spark, d).where(F.col("rank") <= TOP), questions(spark, d)
    if asked.count() * TOP <= R.BROADCAST_ROWS:  # then the lists go to the index, which is not shuffled
        head = F.broadcast(head)
    rows = terms.join(head, "id").join(asked, "qid")
    return R.rerank(rows, R.scorer_named("token_overlap"), question="words", text="terms", depth=HEAD).drop("terms", "words")


def rerank_head(spark, d):
    return reranked(spark, d).select("qid", "id", F.round("rerank", 6).alias("rerank"), long("final_rank"))


def hybrid_retrieve(spark, d):
    """Two lexical lists fused, the head reranked, cut to five; each row with the scores of all lists, null where a list lacks it."""
    out = reranked(spark, d).where(F.col("final_rank") <= HEAD)
    return out.select("qid", "id", long("final_rank"), F.round("rrf", 9).alias("rrf"), F.round("rerank", 6).alias("rerank"), F.round("bm25", 6).alias("bm25"), F.round("flat", 6).alias("flat"))


def context_articles(spark, d):
    rows = read(spark, d, "documents").select(F.col("lang").alias("qid"), F.col("doc_id").alias("rank"), F.col("n_chars").alias("article"), (F.col("doc_id") % 5).alias("part_index"), "text")
    out = R.context_articles(rows, max_sources=4)
    return out.select("qid", "article", long("place"), F.md5(F.col("text").cast("binary")).alias("digest"))


def recall_mrr(spark, d):
    scores = E.question_scores(E.first_ranks(expected(spark, d), bm25(spark, d)))
    return E.summary(scores)


def relevant(spark, d, *, flip: bool = False) -> DataFrame:
    """(qid, rank, id, relevant, qlabel, score) of dense search; the flipped run ranks by the other parity first."""
    asked, _ = vectors(spark, d)
    labels = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    rows = dense(spark, d, 20).join(labels, "id").join(asked.select("qid", "qlabel"), "qid").withColumn("relevant", F.col("label") == F.col("qlabel"))
    return rows if not flip else rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy((F.col("id") % 2), "rank")))


def label_scores(spark, d, *, flip: bool = False) -> DataFrame:
    rows = relevant(spark, d, flip=flip)
    hits = [F.bool_or(F.col("relevant") & (F.col("rank") <= k)).alias(f"hit_{k}") for k in E.KS]
    return rows.groupBy("qid", F.col("qlabel").alias("kind")).agg(*hits, F.coalesce(1.0 / F.min(F.when(F.col("relevant"), F.col("rank"))), F.lit(0.0)).alias("reciprocal")).withColumn("parity", (F.floor(F.col("qid") / 50) % 2).cast("int"))


def recall_breakdown(spark, d):
    return E.summary(label_scores(spark, d), by=("kind", "parity")).select("kind", "parity", long("set_id"), "questions", *[f"recall_{k}" for k in E.KS], "mrr")


def top1_score_stats(spark, d):
    tops = relevant(spark, d).where("rank = 1").select("relevant", "score", (F.col("score") * 2).alias("double_score"))
    out = E.score_stats(tops, ["score", "double_score"], "relevant")
    return out.select("relevant", "score_name", *[F.round(c, 6).alias(c) for c in ("low", "middle", "high")])


def pair_agreement(spark, d):
    tops = relevant(spark, d).where("rank = 1").select(F.floor(F.col("qid") / 100).alias("pair_id"), (F.floor(F.col("qid") / 100) % 2).cast("int").alias("kind"), F.col("label").alias("top"))
    return E.pair_agreement(tops, "kind").select("kind", long("set_id"), "pairs", "agreement")


def context_precision(spark, d):
    return E.context_precision(relevant(spark, d).select("qid", "rank", "relevant"), 5)


def run_fixed_broken(spark, d):
    return E.fixed_broken(label_scores(spark, d), label_scores(spark, d, flip=True), "hit_3")


def group_deltas(spark, d):
    base, run = label_scores(spark, d), label_scores(spark, d, flip=True)
    both = base.select("qid", "kind", "parity", F.col("hit_3").alias("was")).join(run.select("qid", F.col("hit_3").alias("now")), "qid")
    return E.group_deltas(both, ("kind", "parity")).select("kind", "parity", long("set_id"), "questions", "base_hits", "run_hits")


def stratified_subset(spark, d):
    return E.stratified_subset(read(spark, d, "documents"), ["lang", "source"], "doc_id", 90).select("doc_id", "lang", "source")


def pick_first_per_group(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    return E.pick_first_per_group(rows, "source", "doc_id", "toxic").select("source", "toxic", "doc_id")


def answered(spark, d) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", "lang", "text", "n_chars").join(read(spark, d, "labels"), "doc_id")
    return rows.withColumn("score", F.when(F.col("quality") == 1, (F.col("n_chars") % 10) / 10.0))


def answer_means(spark, d):
    return E.answer_means(answered(spark, d).select("lang", "score", F.col("toxic").alias("toxic")), ["score", "toxic"], "lang").select("lang", long("set_id"), "n", "mean_score", "mean_toxic")


def loss_attribution(spark, d):
    rows = answered(spark, d)
    stage = E.loss_stage(F.col("toxic") == 1, F.col("score"), F.col("doc_id") % 4 != 0, F.col("n_chars") < 600)
    return E.loss_attribution(rows.select(stage.alias("stage"), "score"))


def shared_question_means(spark, d):
    rows = answered(spark, d)
    runs = rows.where("score IS NOT NULL").select(F.col("doc_id").alias("qid"), F.lit("a").alias("run"), "score").unionByName(
        rows.where("toxic = 0").select(F.col("doc_id").alias("qid"), F.lit("b").alias("run"), F.coalesce("score", F.lit(0.5)).alias("score"))
    )
    shared = E.shared_questions(runs, 2)
    return runs.join(shared, "qid", "left_semi").groupBy("run").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


def repeatability(spark, d):
    a = read(spark, d, "documents").select("doc_id", "text", "n_chars")
    b = a.select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.lit("changed")).otherwise(F.col("text")).alias("again"))
    return a.join(b, "doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("text") == F.col("again")).alias("identical"))


def distill_pairs(spark, d):
    rows = reranked(spark, d).select("qid", "id", F.col("id").alias("source"), F.col("rerank").alias("teacher"))
    truth = expected(spark, d).groupBy("qid").agg(F.sort_array(F.collect_set("id")).alias("articles"))
    out = R.distill_pairs(rows.join(truth, "qid"))
    return out.select("qid", "id", F.round("logit", 6).alias("logit"), "label")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        token_index, hybrid_retrieve, bm25_stats, bm25_weights, bm25_topk, dense_topk, rrf_fusion, rerank_head, context_articles,         recall_mrr, recall_breakdown, top1_score_stats, pair_agreement, context_precision, run_fixed_broken, group_deltas, stratified_subset, pick_first_per_group,
        answer_means, loss_attribution, shared_question_means, repeatability, distill_pairs,
    )
}


def bm25_sql(name: str, *, stopwords: bool = False, b: float = R.B) -> str:
    """CTEs that end in ``name`` (qid, id, score, rank)."""
    words = f"list_filter({TOKENS}, lambda x: NOT list_contains({LUCENE}, x))" if stopwords else TOKENS
    return f"""{name}_w AS (SELECT doc_id AS id, {words} AS w FROM documents), {name}_s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM {name}_w),
        {name}_p AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM {name}_w) GROUP BY id, term),
        {name}_d AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
        {name}_q AS (SELECT qid, term, count(*) AS times FROM (SELECT item_id AS qid, unnest({words}) AS term FROM benchmark) GROUP BY qid, term),
        {name}_c AS (SELECT qid, id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - {b} + {b} * dl / avgdl))), 9) AS score
            FROM {name}_q JOIN {name}_p USING (term) JOIN {name}_d USING (term) CROSS JOIN {name}_s GROUP BY qid, id),
        {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {name}_c WHERE score > 0) WHERE rank <= {TOP})"""


LEXICAL = bm25_sql("one") + ", " + bm25_sql("two", stopwords=True, b=0.0)
FUSED = LEXICAL + """, rrf_ AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS rrf FROM (SELECT qid, id, rank FROM one UNION ALL SELECT qid, id, rank FROM two) GROUP BY qid, id),
        fused AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, id) AS rank FROM rrf_)"""
RERANKED = FUSED + f""", asked AS (SELECT item_id AS qid, list_distinct({TOKENS}) AS a FROM benchmark), bodies AS (SELECT doc_id AS id, {TOKENS} AS w FROM documents),
        over AS (SELECT f.*, round(coalesce(len(list_intersect(a, w))::DOUBLE / nullif(len(a), 0), 0), 9) AS rerank FROM fused f JOIN asked USING (qid) JOIN bodies USING (id) WHERE f.rank <= {TOP}),
        reranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY (rank > {HEAD})::INT, CASE WHEN rank <= {HEAD} THEN -rerank END, rank) AS final_rank FROM over)"""
TRUTH = "truth AS (SELECT DISTINCT item_id AS qid, doc_id AS id FROM benchmark b, documents d WHERE contains(d.text, b.text))"
COSINE = "list_dot_product(q, v) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v)))"
DENSE = f"""dall AS (SELECT a.vec_id AS qid, a.label AS qlabel, b.vec_id AS id, b.label AS label, a.embedding::DOUBLE[] AS q, b.embedding::DOUBLE[] AS v FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        dscore AS (SELECT qid, qlabel, id, label, round({COSINE}, 9) AS score FROM dall),
        dense AS (SELECT *, qlabel = label AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM dscore) WHERE rank <= 20),
        flipped AS (SELECT * REPLACE (row_number() OVER (PARTITION BY qid ORDER BY id % 2, rank) AS rank) FROM dense)"""


def label_scores_sql(name: str, source: str) -> str:
    hits = ", ".join(f"bool_or(relevant AND rank <= {k}) AS hit_{k}" for k in E.KS)
    return f"{name} AS (SELECT qid, qlabel AS kind, {hits}, coalesce(1.0::DOUBLE / min(rank) FILTER (relevant), 0) AS reciprocal, ((qid // 50) % 2)::INT AS parity FROM {source} GROUP BY qid, qlabel)"


RECALLS = ", ".join(f"round(avg(hit_{k}::INT), 6) AS recall_{k}" for k in E.KS)
BOTH = f"""WITH {DENSE}, {label_scores_sql('base', 'dense')}, {label_scores_sql('run', 'flipped')},
        both_ AS (SELECT b.qid, b.kind, b.parity, b.hit_3 AS was, r.hit_3 AS now FROM base b JOIN run r USING (qid))"""
ANSWERED = "a AS (SELECT d.doc_id, d.lang, d.text, d.n_chars, l.quality, l.toxic, CASE WHEN quality = 1 THEN (d.n_chars % 10) / 10.0::DOUBLE END AS score FROM documents d JOIN labels l USING (doc_id))"

ORACLES: dict[str, str] = {
    "token_index": f"SELECT doc_id, len({TOKENS})::BIGINT AS dl, len(list_distinct({TOKENS}))::BIGINT AS n_terms FROM documents",
    "hybrid_retrieve": f"""WITH {RERANKED} SELECT qid, id, final_rank::BIGINT AS final_rank, round(rrf, 9) AS rrf, round(rerank, 6) AS rerank, round(one.score, 6) AS bm25, round(two.score, 6) AS flat
        FROM reranked LEFT JOIN one USING (qid, id) LEFT JOIN two USING (qid, id) WHERE final_rank <= {HEAD}""",
    "bm25_stats": f"""WITH w AS (SELECT {TOKENS} AS w FROM documents) SELECT count(*)::BIGINT AS n_docs, round(avg(len(w)), 6) AS avg_len, max(len(w))::BIGINT AS max_len, count(*) FILTER (len(w) = 0)::BIGINT AS n_empty,
        (SELECT count(DISTINCT t)::BIGINT FROM (SELECT unnest(w) AS t FROM w)) AS vocabulary FROM w""",
    "bm25_weights": f"""WITH {bm25_sql('one')}, x AS (SELECT id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) AS weight FROM one_p JOIN one_d USING (term) CROSS JOIN one_s)
        SELECT id AS doc_id, count(*)::BIGINT AS n_terms, round(sum(weight), 6) AS weight, round(max(weight), 6) AS heaviest FROM x GROUP BY id""",
    "bm25_topk": f"WITH {bm25_sql('one')} SELECT qid, id, score, rank::BIGINT AS rank FROM one",
    "dense_topk": f"WITH {DENSE} SELECT qid, id, round(score, 6) AS score, rank::BIGINT AS rank FROM dense WHERE rank <= {TOP}",
    "rrf_fusion": f"WITH {FUSED} SELECT qid, id, round(rrf, 9) AS rrf, rank::BIGINT AS rank FROM fused",
    "rerank_head": f"WITH {RERANKED} SELECT qid, id, round(rerank, 6) AS rerank, final_rank::BIGINT AS final_rank FROM reranked",
    "context_articles": """WITH r AS (SELECT lang AS qid, doc_id AS rank, n_chars AS article, doc_id % 5 AS part_index, text FROM documents),
        g AS (SELECT qid, article, min(rank) AS first_rank, string_agg(text, chr(10) ORDER BY part_index, text) AS text FROM r GROUP BY qid, article),
        p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first_rank, article) AS place FROM g) SELECT qid, article, place::BIGINT AS place, md5(text) AS digest FROM p WHERE place <= 4""",
    "recall_mrr": f"""WITH {bm25_sql('one')}, {TRUTH}, f AS (SELECT t.qid, t.id, one.rank FROM truth t LEFT JOIN one ON t.qid = one.qid AND t.id = one.id),
        s AS (SELECT qid, {', '.join(f'coalesce(bool_or(rank <= {k}), false) AS hit_{k}' for k in E.KS)}, coalesce(1.0::DOUBLE / min(rank), 0) AS reciprocal FROM f GROUP BY qid)
        SELECT count(*)::BIGINT AS questions, {RECALLS}, round(avg(reciprocal), 6) AS mrr FROM s""",
    "recall_breakdown": f"""WITH {DENSE}, {label_scores_sql('s', 'dense')} SELECT kind, parity, grouping(kind, parity)::BIGINT AS set_id, count(*)::BIGINT AS questions, {RECALLS}, round(avg(reciprocal), 6) AS mrr
        FROM s GROUP BY GROUPING SETS ((), (kind), (parity))""",
    "top1_score_stats": f"""WITH {DENSE}, s AS (SELECT relevant, 'score' AS score_name, score AS v FROM dense WHERE rank = 1 UNION ALL SELECT relevant, 'double_score', 2 * score FROM dense WHERE rank = 1)
        SELECT relevant, score_name, round(min(v), 6) AS low, round(median(v), 6) AS middle, round(max(v), 6) AS high FROM s GROUP BY relevant, score_name""",
    "pair_agreement": f"""WITH {DENSE}, p AS (SELECT qid // 100 AS pair_id, ((qid // 100) % 2)::INT AS kind, count(*) AS n, min(label) = max(label) AS same FROM dense WHERE rank = 1 GROUP BY ALL)
        SELECT kind, grouping(kind)::BIGINT AS set_id, count(*)::BIGINT AS pairs, round(avg(same::INT), 6) AS agreement FROM p WHERE n = 2 GROUP BY GROUPING SETS ((), (kind))""",
    "context_precision": f"""WITH {DENSE}, x AS (SELECT qid, relevant, sum(relevant::INT) OVER (PARTITION BY qid ORDER BY rank)::DOUBLE / rank AS p FROM dense WHERE rank <= 5)
        SELECT qid, round(coalesce(avg(p) FILTER (relevant), 0), 6) AS precision FROM x GROUP BY qid""",
    "run_fixed_broken": f"{BOTH} SELECT count(*)::BIGINT AS questions, count(*) FILTER (NOT was AND now)::BIGINT AS fixed, count(*) FILTER (was AND NOT now)::BIGINT AS broken, (count(*) FILTER (NOT was AND now) - count(*) FILTER (was AND NOT now))::BIGINT AS net FROM both_",
    "group_deltas": f"""{BOTH} SELECT kind, parity, grouping(kind, parity)::BIGINT AS set_id, count(*)::BIGINT AS questions, count(*) FILTER (was)::BIGINT AS base_hits, count(*) FILTER (now)::BIGINT AS run_hits
        FROM both_ GROUP BY GROUPING SETS ((kind), (parity)) HAVING count(*) FILTER (was) <> count(*) FILTER (now)""",
    "stratified_subset": "SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, lang, source, doc_id LIMIT 90",
    "pick_first_per_group": """WITH r AS (SELECT * FROM documents JOIN labels USING (doc_id)), g AS (SELECT source, row_number() OVER (ORDER BY min(doc_id)) - 1 AS place FROM r GROUP BY source)
        SELECT source, toxic, min(doc_id) AS doc_id FROM r JOIN g USING (source) WHERE (place % 2 = 0) = (toxic = 0) GROUP BY source, toxic""",
    "answer_means": f"WITH {ANSWERED} SELECT lang, grouping(lang)::BIGINT AS set_id, count(*)::BIGINT AS n, round(avg(score), 4) AS mean_score, round(avg(toxic), 4) AS mean_toxic FROM a GROUP BY GROUPING SETS ((), (lang))",
    "loss_attribution": f"""WITH {ANSWERED}, s AS (SELECT CASE WHEN toxic = 1 OR score IS NULL THEN NULL WHEN doc_id % 4 = 0 THEN 'retrieval' WHEN n_chars < 600 THEN 'refusal' ELSE 'generator' END AS stage, score FROM a),
        l AS (SELECT stage, sum(1 - score) AS lost FROM s WHERE stage IS NOT NULL GROUP BY stage) SELECT stage, round(lost, 6) AS lost, round(lost / sum(lost) OVER (), 6) AS share FROM l""",
    "shared_question_means": f"""WITH {ANSWERED}, r AS (SELECT doc_id AS qid, 'a' AS run, score FROM a WHERE score IS NOT NULL UNION ALL SELECT doc_id, 'b', coalesce(score, 0.5) FROM a WHERE toxic = 0),
        k AS (SELECT qid FROM r GROUP BY qid HAVING count(DISTINCT run) = 2) SELECT run, count(*)::BIGINT AS n, round(avg(score), 6) AS mean_score FROM r WHERE qid IN (SELECT qid FROM k) GROUP BY run""",
    "repeatability": "SELECT count(*)::BIGINT AS n, count(*) FILTER (doc_id % 10 <> 0)::BIGINT AS identical FROM documents",
    "distill_pairs": f"""WITH {RERANKED}, {TRUTH}, t AS (SELECT DISTINCT qid FROM truth), x AS (SELECT r.qid, r.id, least(greatest(rerank, 1e-6), 1 - 1e-6) AS p FROM reranked r JOIN t USING (qid))
        SELECT x.qid, x.id, round(ln(p / (1 - p)), 6) AS logit, (EXISTS (SELECT 1 FROM truth WHERE truth.qid = x.qid AND truth.id = x.id))::INT AS label FROM x""",
}
