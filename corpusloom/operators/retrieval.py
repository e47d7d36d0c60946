"""Set-at-a-time retrieval: all questions in one job.

Indexes are ordinary tables: one row a document with its length and term counts, postings (term, id, tf, dl) taken from
it, vectors. A ranked list is a table (qid, id, score, rank). Questions are the small side; they are left to the optimiser, which broadcasts them only
below its size limit, and the corpus is never broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.vectors import norm

K1, B, RRF_K = 1.5, 0.75, 60
#: Rows of (question, term) that are sent to all tasks, at most.
BROADCAST_ROWS = 500_000
#: Questions whose scores a task holds side by side, at most.
MOST_QUESTIONS = 10_000


def ranked(rows: DataFrame, *order: Column, k: int | None = None, by: str = "qid") -> DataFrame:
    """Adds rank, from 1, within each question; with k only the first k (pruned before the shuffle)."""
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return out if k is None else out.where(F.col("rank") <= k)


def token_index(docs: DataFrame, words: Column, *, id: str) -> DataFrame:
    """(id, dl, terms): each document's length in tokens and its distinct terms with counts, made row by row without a shuffle.

    Null and empty texts have length 0 and no terms. Written once, it serves all lists and statistics.
    """
    listed = docs.select(F.col(id).alias("id"), F.sort_array(F.coalesce(words, F.array().cast("array<string>"))).alias("w"))
    places = F.when(F.size("w") > 0, F.sequence(F.lit(1), F.size("w"))).otherwise(F.array().cast("array<int>"))
    first = F.filter(places, lambda i: (i == 1) | (F.element_at("w", i) != F.get("w", i - 2)))
    ends = listed.withColumn("first", first)
    count = lambda i, k: F.struct(F.element_at("w", i).alias("term"), (F.coalesce(F.get("first", k + 1), F.size("w") + 1) - i).cast("long").alias("tf"))
    return ends.select("id", F.size("w").alias("dl"), F.transform("first", count).alias("terms"))


def without_terms(index: DataFrame, drop: list[str]) -> DataFrame:
    """The index of the same documents without some terms, stopwords say: lengths count what is left."""
    if not drop:
        return index
    kept = index.select("id", F.filter("terms", lambda t: ~t["term"].isin(drop)).alias("terms"))
    return kept.select("id", F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + t["tf"]).cast("int").alias("dl"), "terms")


def postings(index: DataFrame) -> DataFrame:
    """(id, dl, term, tf) of all documents with terms."""
    return index.select("id", "dl", F.inline("terms"))


def corpus_stats(index: DataFrame) -> DataFrame:
    """One row: n documents, average length, largest length, documents without terms."""
    return index.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_len"), F.max("dl").cast("long").alias("max_len"), F.count_if(F.col("dl") == 0).alias("n_empty"))


def idf() -> Column:
    return F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def bm25_weights(posted: DataFrame, stats: DataFrame, *, k1: float = K1, b: float = B) -> DataFrame:
    """(term, id, weight): idf * tf / (tf + k1 (1 - b + b dl / avgdl)), idf = ln(1 + (N - df + 0.5) / (df + 0.5)).

    Terms are counted from the postings given, with partial sums, and meet them again by term: a term of many postings is
    split by the optimiser, one side being a row a term.
    """
    df = posted.groupBy("term").agg(F.count("*").alias("df"))
    part = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_len")))
    # stats is one row
    return posted.join(df, "term").crossJoin(F.broadcast(stats)).select("term", "id", (idf() * part).alias("weight"))


def bm25_search(questions: DataFrame, index: DataFrame, *, k: int, k1: float = K1, b: float = B, broadcast_rows: int = BROADCAST_ROWS, most_questions: int = MOST_QUESTIONS) -> DataFrame:
    """(qid, id, score, rank) of (qid, words) over a token index: the k best of each question.

    A repeated question term adds again; documents without a question term are no result, nor are zero scores.
    Question terms and their document counts go to the documents, if they are few by count: then a task scores its own
    documents and gives up to k rows a question, so that no posting is shuffled. Of more question terms, postings and terms meet by term.
    With b = 0 lengths do not count, and are not read.
    """
    asked = questions.select("qid", F.explode("words").alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    size = asked.agg(F.count("*").alias("rows"), F.count_distinct(F.struct("qid")).alias("questions")).head()
    if size["rows"] <= broadcast_rows and size["questions"] <= most_questions:
        scored = best_by_task(asked, index, k=k, k1=k1, b=b)
    else:
        posted = postings(index)
        df = posted.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
        # stats is one row
        terms = asked.join(df, "term").crossJoin(F.broadcast(corpus_stats(index))).select("term", "qid", (F.col("times") * idf()).alias("w"), "avg_len")
        part = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_len")))
        scored = posted.join(terms, "term").groupBy("qid", "id").agg(F.round(F.sum(F.col("w") * part), 9).alias("score")).where("score > 0")
    return ranked(scored, F.desc("score"), F.asc("id"), k=k)


def best_by_task(asked: DataFrame, index: DataFrame, *, k: int, k1: float, b: float, block: int = 1 << 18) -> DataFrame:
    """(qid, id, score) of (qid, term, times): the k best of each question among each task's documents.

    Asked terms with their questions, and the counts of documents that hold them, are sent to all tasks: a bounded number of rows.
    A task looks its documents' terms up among them and sums by question and document, about ``block`` sums and products at a
    time; of these it keeps what is among the k best so far.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = asked.collect()
    qids, words = list(dict.fromkeys(r["qid"] for r in rows)), sorted({r["term"] for r in rows if r["term"] is not None})
    q_of, w_of, vocabulary = {q: i for i, q in enumerate(qids)}, {w: i for i, w in enumerate(words)}, pa.array(words, pa.string())
    if not words:
        return asked.join(index.select("id"), F.lit(False)).select("qid", "id", F.lit(0.0).alias("score"))

    def pieces(batches):
        """Some documents at a time, so that a task holds few arrays of a batch's length."""
        for batch in batches:
            yield from (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000))

    def count(batches):
        held = np.zeros(len(vocabulary), np.int64)
        for batch in pieces(batches):
            at = pc.index_in(batch.column("term").flatten(), vocabulary).drop_null()
            held += np.bincount(at.to_numpy(zero_copy_only=False), minlength=len(held))
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.flatnonzero(held), pa.int32()), "n": pa.array(held[held > 0], pa.int64())})

    df = np.zeros(len(words))
    for r in index.select("terms.term").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        df[r["at"]] = r["n"]
    stats = index.agg(F.count("*").alias("n"), (F.avg("dl") if b else F.lit(1.0)).alias("avg_len")).head()
    idf_of = np.log(1 + (stats["n"] - df + 0.5) / (df + 0.5))
    entries = sorted((w_of[r["term"]], q_of[r["qid"]], r["times"]) for r in rows if r["term"] is not None)
    asked_w, asked_q, times = (np.array([e[i] for e in entries]) for i in range(3))
    weight, starts = times * idf_of[asked_w], np.searchsorted(asked_w, np.arange(len(words) + 1))
    avg_len = stats["avg_len"] or 1.0
    n_q = len(qids)

    def best(batches):
        held, least = None, np.zeros(n_q)  # the k-th best score of each question so far
        for batch in pieces(batches):
            terms, n_docs = batch.column("term"), batch.num_rows
            at = pc.index_in(terms.flatten(), vocabulary)
            hit = at.is_valid().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(n_docs), pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False))[hit]
            at, tf = at.drop_null().to_numpy(zero_copy_only=False), batch.column("tf").flatten().to_numpy(zero_copy_only=False)[hit]
            long = k1 * (1 - b + b * batch.column("dl").to_numpy(zero_copy_only=False)[doc] / avg_len) if b else k1
            part, fan = tf / (tf + long), np.diff(starts)[at]
            cost = np.cumsum(np.bincount(doc, fan, minlength=n_docs) + n_q)
            cuts = [0, *(np.flatnonzero(np.diff(cost // block)) + 1), n_docs]
            found = [] if held is None else [held]
            for low, high in zip(cuts, cuts[1:]):
                mine = slice(*np.searchsorted(doc, (low, high)))
                n = fan[mine]
                place = np.arange(n.sum()) + np.repeat(starts[at[mine]] - (np.cumsum(n) - n), n)
                key = asked_q[place] * (high - low) + np.repeat(doc[mine] - low, n)
                scores = np.bincount(key, weight[place] * np.repeat(part[mine], n), minlength=n_q * (high - low)).reshape(n_q, -1)
                scores = np.floor(scores * 1e9 + 0.5) / 1e9
                if high - low > k:
                    least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
                q, d = np.nonzero((scores > 0) & (scores >= least[:, None]))  # ties go on, the smaller id decides
                found.append(pa.table({"q": pa.array(q, pa.int32()), "id": batch.column("id").take(pa.array(low + d)), "score": scores[q, d]}))
                if sum(map(len, found)) > block:
                    found = [first(pa.concat_tables(found))]
            held = first(pa.concat_tables(found))
            q, n = held["q"].to_numpy(), np.bincount(held["q"].to_numpy(), minlength=n_q)
            full = n >= k
            least[full] = np.maximum(least[full], held["score"].to_numpy()[np.cumsum(n)[full] - 1])
        if held is not None:
            yield from held.combine_chunks().to_batches()

    def first(table):
        """The k best rows of each question, in order."""
        table = table.take(pc.sort_indices(table, sort_keys=[("q", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start"))
        q = table["q"].to_numpy()
        return table.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < k))

    columns = ["id", *(["dl"] if b else []), F.col("terms.term").alias("term"), F.col("terms.tf").alias("tf")]
    out = index.select(*columns).mapInArrow(best, f"q int, id {index.schema['id'].dataType.simpleString()}, score double")
    numbered = asked.sparkSession.createDataFrame(list(enumerate(qids)), f"q int, qid {asked.schema['qid'].dataType.simpleString()}")
    return out.join(F.broadcast(numbered), "q").select("qid", "id", "score")


def dense_search(questions: DataFrame, vectors: DataFrame, *, k: int, skip_self: bool = True, block: int = 4096, at_once: int = 256) -> DataFrame:
    """(qid, id, score, rank) of (qid, qvec) against (id, vec): exact cosine, to 9 digits, 0 without a norm or of another length.

    A stated question set meets all vectors in blocks: a task holds up to about ``block`` of each and multiplies them as
    matrices, ``at_once`` questions at a time, and gives up to k rows a question. Rows shipped are vectors times blocks of questions and the reverse.
    """
    import numpy as np
    import pandas as pd

    n, m = vectors.count(), questions.count()
    held, asked = max(1, -(-n // block)), max(1, -(-m // block))
    part = lambda id, size: F.pmod(F.xxhash64(id), F.lit(size)).cast("int")
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    doubles = lambda v: F.transform(v, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    no_id, no_qid = (F.lit(None).cast(x.schema[c].dataType) for x, c in ((vectors, "id"), (questions, "qid")))
    rows = vectors.select(part("id", held).alias("i"), every(asked).alias("j"), "id", no_qid.alias("qid"), F.lit(False).alias("asks"), doubles("vec").alias("v"))
    rows = rows.unionByName(questions.select(every(held).alias("i"), part("qid", asked).alias("j"), no_id.alias("id"), "qid", F.lit(True).alias("asks"), doubles("qvec").alias("v")))

    def nearest(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy()
        ids, qids = group["id"][~asks].reset_index(drop=True), group["qid"][asks].reset_index(drop=True)
        if not len(ids) or not len(qids):
            return pd.DataFrame({"qid": group["qid"][:0], "id": group["id"][:0], "score": np.zeros(0)})
        vectors, wanted = group["v"][~asks].tolist(), group["v"][asks].tolist()
        order = ids.argsort(kind="stable").to_numpy()  # ties go to the smaller id
        return pd.concat([best(qids[i : i + at_once], wanted[i : i + at_once], ids, vectors, order) for i in range(0, len(qids), at_once)])

    def best(qids: pd.Series, wanted: list, ids: pd.Series, vectors: list, order: np.ndarray) -> pd.DataFrame:
        """The k best of some questions: their scores are all that is held of the block's pairs."""
        sizes = {len(v) for v in wanted if v is not None}
        scores = np.zeros((len(wanted), len(vectors)))
        for size in sizes:  # as a rule there is one
            q, x = [i for i, v in enumerate(wanted) if v is not None and len(v) == size], [i for i, v in enumerate(vectors) if v is not None and len(v) == size]
            if size and x:
                a, b = np.array([wanted[i] for i in q]), np.array([vectors[i] for i in x])
                norms = np.sqrt((a**2).sum(1))[:, None] * np.sqrt((b**2).sum(1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    scores[np.ix_(q, x)] = np.where(norms > 0, np.round(a @ b.T / norms, 9), 0.0)
        out = []
        for i, qid in enumerate(qids):
            mine = order[(ids[order] != qid).to_numpy()] if skip_self else order
            top = mine[np.argsort(-scores[i, mine], kind="stable")[:k]]
            out.append(pd.DataFrame({"qid": [qid] * len(top), "id": ids[top].to_numpy(), "score": scores[i, top]}))
        return pd.concat(out)

    kinds = f"qid {questions.schema['qid'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"
    return ranked(rows.groupBy("i", "j").applyInPandas(nearest, kinds), F.desc("score"), F.asc("id"), k=k)


def rrf(lists: list[DataFrame], *, k: int = RRF_K, scores: list[str] | None = None) -> DataFrame:
    """(qid, id, rrf, rank): sum over lists of 1 / (k + rank); with ``scores`` also each list's score, null where a list lacks the id.

    An id that repeats in a list counts at its best rank there; later ranks stay as they are. Ties go to the smaller id.
    """
    if k < 0:
        raise ValueError("k is negative")
    every = None
    for i, rows in enumerate(lists):
        one = rows.select("qid", "id", "rank", F.lit(i).alias("list"), (F.col("score") if scores else F.lit(None)).cast("double").alias("score"))
        every = one if every is None else every.unionByName(one)
    best = every.groupBy("qid", "id", "list").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
    kept = [F.max(F.when(F.col("list") == i, F.col("score"))).alias(name) for i, name in enumerate(scores or [])]
    fused = best.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 12).alias("rrf"), *kept)
    return ranked(fused, F.desc("rrf"), F.asc("id"))


def rerank_head(rows: DataFrame, *, depth: int, score: str = "rerank") -> DataFrame:
    """Reorders the first ``depth`` of each list by score, ties by rank; the tail stays. Adds final_rank."""
    head = F.col("rank") <= depth
    order = Window.partitionBy("qid").orderBy((~head).cast("int"), F.when(head, F.col(score)).desc_nulls_last(), "rank")
    return rows.withColumn("final_rank", F.row_number().over(order))


def token_overlap(question_words: Column, words: Column) -> Column:
    """A scorer without a model: the share of the question's distinct words in the text."""
    asked = F.array_distinct(question_words)
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(asked, words)), F.size(asked)), F.lit(0.0)), 9)


def rerank(rows: DataFrame, scorer: Callable[[Column, Column], Column] | None, *, question: str, text: str, depth: int, score: str = "rerank") -> DataFrame:
    """Scores candidates by a scorer of (question, text) and reorders each list's head; without a scorer the order stays, scores are null.

    The scorer is what a caller plugs in: column functions, or a pandas UDF around a model.
    """
    value = F.lit(None).cast("double") if scorer is None else scorer(F.col(question), F.col(text)).cast("double")
    return rerank_head(rows.withColumn(score, value), depth=depth, score=score)


def embedded(rows: DataFrame, embedder: Callable[[Column], Column], *, text: str, name: str = "vec", dim: int | None = None) -> DataFrame:
    """Adds the vector that an embedder gives a text, scaled to length 1 as array<double>; null and blank texts have a null vector.

    With ``dim`` a vector of another length raises as it is made.
    """
    v = embedder(F.col(text)).cast("array<double>")
    out = rows.withColumn(name, F.when(F.trim(text) != "", v))
    if dim is not None:
        wrong = F.col(name).isNotNull() & (F.size(name) != dim)
        out = out.withColumn(name, F.when(wrong, F.raise_error(F.concat(F.lit(f"embedder: expected {dim} numbers, found "), F.size(name).cast("string")))).otherwise(F.col(name)))
    size = norm(F.col(name))
    return out.withColumn(name, F.when(size > 0, F.transform(name, lambda x: x / size)).otherwise(F.col(name)))


#: Scorers and embedders by name; ``none`` leaves a list as it is.
SCORERS: dict[str, Callable[[Column, Column], Column] | None] = {"none": None, "token_overlap": token_overlap}


def scorer_named(name: str) -> Callable[[Column, Column], Column] | None:
    if name not in SCORERS:
        raise ValueError(f"no scorer {name}; there are {', '.join(sorted(SCORERS))}")
    return SCORERS[name]


def predictions(questions: DataFrame, lists: DataFrame, chunks: DataFrame, *, top_k: int) -> DataFrame:
    """(qid, citations): the citation of each of a question's first top_k chunks, in order of rank.

    lists: (qid, rank, id); chunks: (id, citation). A question without results has an empty array.
    """
    cited = lists.where(F.col("rank") <= top_k).join(chunks.select("id", "citation"), "id")
    listed = cited.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "citation"))).alias("c"))  # at most top_k a question
    none = F.array().cast("array<string>")
    return questions.select("qid").distinct().join(listed, "qid", "left").select("qid", F.coalesce(F.transform("c", lambda x: x["citation"].cast("string")), none).alias("citations"))


def by_priority(lists: list[DataFrame]) -> DataFrame:
    """(qid, id, priority, rank): earlier lists first, an id once, at its first place."""
    every = None
    for i, rows in enumerate(lists):
        one = rows.select("qid", "id", F.lit(i).alias("priority"), "rank")
        every = one if every is None else every.unionByName(one)
    place = every.groupBy("qid", "id").agg(F.min(F.struct("priority", "rank")).alias("p"))
    return ranked(place.select("qid", "id", "p.priority", F.col("p.rank").alias("list_rank")), F.col("priority"), F.col("list_rank"), F.col("id"))


def covered(chunks: DataFrame, first: str = "article", last: str = "range_end") -> DataFrame:
    """Adds ``number``: a row for each article that a chunk stands for, which turns the range join into an equi-join."""
    return chunks.withColumn("number", F.explode(F.sequence(F.col(first), F.coalesce(F.col(last), F.col(first)))))


def expand_citations(lists: DataFrame, cites: DataFrame, *, top_k: int) -> DataFrame:
    """(qid, position, id, cited_by): each listed chunk followed by not yet listed parts that it cites, cut to top_k.

    lists: (qid, rank, id); cites: (id, cited array in order). A later chunk that was inserted already is skipped
    and does not expand. The walk is an ordered fold over one question's list, at most a few dozen long.
    """
    kind = "array<struct<id:string,cited_by:string>>"
    one = lists.join(cites, "id", "left").groupBy("qid").agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("id"), F.coalesce(F.col("cited").cast("array<string>"), F.array().cast("array<string>")).alias("cited")))).alias("walk")
    )

    def step(out: Column, c: Column) -> Column:
        seen = F.transform(out, lambda x: x["id"])
        me = F.array(F.struct(c["id"].alias("id"), F.lit(None).cast("string").alias("cited_by")))
        new = F.filter(F.array_distinct(c["cited"]), lambda x: ~F.array_contains(seen, x) & (x != c["id"]))
        more = F.transform(new, lambda x: F.struct(x.alias("id"), c["id"].alias("cited_by")))
        go = (F.size(out) < top_k) & ~F.array_contains(seen, c["id"])
        return F.when(go, F.concat(out, me, more).cast(kind)).otherwise(out)

    walked = one.select("qid", F.slice(F.aggregate("walk", F.array().cast(kind), step), 1, top_k).alias("found"))
    return walked.select("qid", F.posexplode("found").alias("at", "c")).select("qid", (F.col("at") + 1).alias("position"), "c.id", "c.cited_by")


def repealed_fallback(top: DataFrame, passages: DataFrame, *, below: float, at_least: float) -> DataFrame:
    """(qid, first, passage_score) where the fallback applies.

    top: (qid, is_lookup, rerank) of each question's first result; passages: (qid, idx, first, score). It applies
    without a lookup, with a rerank score under ``below`` and a best passage of ``at_least``; ties go to the first.
    """
    weak = top.where(~F.col("is_lookup") & F.col("rerank").isNotNull() & (F.col("rerank") < below)).select("qid")
    best = passages.groupBy("qid").agg(F.max_by(F.struct("first", "score"), F.struct(F.col("score"), (-F.col("idx")).alias("i"))).alias("b"))
    return best.join(weak, "qid", "left_semi").where(F.col("b.score") >= at_least).select("qid", "b.first", F.col("b.score").alias("passage_score"))


def context_articles(rows: DataFrame, *, max_sources: int) -> DataFrame:
    """(qid, article, place, text): the first distinct articles in rank order, their parts joined in part order.

    rows: (qid, rank, article, part_index, text). Articles are cut to max_sources before their texts are gathered.
    """
    heads = rows.groupBy("qid", "article").agg(F.min("rank").alias("first_rank"))
    order = Window.partitionBy("qid").orderBy("first_rank", "article")
    placed = heads.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max_sources).select("qid", "article", "place")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("part_index", "text"))), lambda x: x["text"])
    return rows.join(placed, ["qid", "article"]).groupBy("qid", "article", "place").agg(F.array_join(parts, "\n").alias("text"))


def split_citations(rows: DataFrame, *, cited: str = "cited", allowed: str = "allowed") -> DataFrame:
    """Adds given and hallucinated, in order of citation."""
    inside = lambda x: F.array_contains(F.col(allowed), x)
    return rows.withColumns({"given": F.filter(cited, inside), "hallucinated": F.filter(cited, lambda x: ~inside(x))})


def distill_pairs(candidates: DataFrame, teacher: str = "teacher") -> DataFrame:
    """Adds logit (probability clipped to 1e-6) and label (the source is among the text's articles)."""
    from corpusloom.functions.vectors import logit

    return candidates.withColumns({"logit": F.round(logit(F.col(teacher)), 9), "label": F.array_contains("articles", F.col("source")).cast("int")})
