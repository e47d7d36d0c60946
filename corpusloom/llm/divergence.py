"""Source divergence audit: how far the word use of each source is from the others of its language.

Counts of a language's common terms give each source smoothed shares in fixed point. Two sources differ by the sum of
|p - q| over all common terms. A share depends on a count alone, so a pair of sources is settled by its joint count
histogram: how many terms have each distinct (count, count) combination. Few terms are seen in a source at all, and the
combinations with a zero, (0, 0) above all, stand for most of them: those with one zero are tallied where the other count
is, (0, 0) is what is missing from the number of terms. |p - q| is then worked out once a combination and weighted by its number.

Tallies are made in blocks of terms by two blocks of sources, each a dense matrix of bounded size, and summed over the blocks of
terms, so that neither a frequent term nor a language of many sources gathers in one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.ann import by_key
from corpusloom.llm.common import Tables, table

#: ASCII letters lower-cased, bytes of other code points kept, all else space: what is left between spaces is a term.
TERM_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
#: Entries that a task counts before it passes them on; terms and sources of a block, about.
HELD_TERMS, BLOCK_TERMS, BLOCK_SOURCES = 200_000, 4096, 32
#: The scale of shares, and what is added to each count.
SCALE, SMOOTHING = 1_000_000_000, 5


def term_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a source's terms and documents that hold them; nulls read as ''.

    Tasks count into a table of bounded size before rows are shuffled.
    """
    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                fixed = [pa.array([x] * len(n), pa.string()) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*fixed, terms, pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], schema=kind)
            held.clear()

        room = HELD_TERMS
        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                here = Counter(text.as_py().translate(TERM_BYTES).split())
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                room += len(n)
                n.update(here)
                docs.update(here.keys())
                room -= len(n)
                if room <= 0:
                    yield from flush()
                    room = HELD_TERMS
        yield from flush()

    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = read.where("text <> ''").mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * terms)), exact at any size; null if there are no terms."""
    top = f"{SCALE} * CAST({count} + {SMOOTHING} AS DECIMAL(20, 0))"
    below = f"CAST({total} + {SMOOTHING} * {terms} AS DECIMAL(20, 0))"
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + ({top}) div ({below}) END")


def kept_counts(counts: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, n, lang_n, lead): rows of the terms that at least min_docs documents of their language hold.

    lang_n: occurrences in the whole language; lead: true on one row of each of its terms.
    """
    w = Window.partitionBy("lang", "term")  # one row a source
    of_lang = counts.withColumns({"lang_docs": F.sum("docs").over(w), "lang_n": F.sum("n").over(w), "lead": F.min("source").over(w) == F.col("source")})
    return of_lang.where(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", "lead")


def source_groups(docs: DataFrame, kept: DataFrame, *, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, at, sources, total, terms, lang_total): each occurring group, numbered within its language from 0.

    Totals are over kept terms, terms is their number in the language; all are 0 where there are none. One row a group.
    """
    empty = lambda c, a: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a)
    groups = docs.select(empty(lang, "lang"), empty(source, "source")).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("lead").cast("long")).alias("terms"))
    w = Window.partitionBy("lang")
    found = groups.join(totals, ["lang", "source"], "left")
    whole = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0).cast("long"))
    number = {"at": F.row_number().over(w.orderBy("source")) - 1, "sources": F.count("*").over(w), "lang_total": whole("total"), "terms": whole("terms")}
    return found.withColumns(number).withColumn("total", F.coalesce("total", F.lit(0).cast("long")))


def joint_histograms(kept: DataFrame, groups: DataFrame, *, block_terms: int = BLOCK_TERMS, block_sources: int = BLOCK_SOURCES) -> DataFrame:
    """(lang, a, b, n_a, n_b, cells): for sources numbered a < b, the terms with counts n_a and n_b, not both zero."""
    rows = kept.join(groups, ["lang", "source"])
    blocks, own = (F.ceil(F.col("sources") / block_sources)).cast("int"), F.floor(F.col("at") / block_sources).cast("int")
    # a block of sources meets each block, itself included, once for each block of terms
    met = rows.withColumns({"part": F.pmod(F.xxhash64("term"), F.ceil(F.col("terms") / block_terms)), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    block = {"low": F.least(own, "other"), "high": F.greatest(own, "other"), "sources": F.col("sources").cast("int")}
    keyed = met.withColumns(block).withColumn("key", F.xxhash64("lang", "part", "low", "high")).select("key", "lang", "part", "low", "high", "sources", "at", "term", "n")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches):
            # blocks whose keys collide are told apart
            names = ["lang", "part", "low", "high", "sources"]
            for b in group.group_by(names, use_threads=False).aggregate([(c, "list") for c in ("at", "term", "n")]).to_batches():
                for i in range(b.num_rows):
                    lang, _, low, high, n_sources = (b.column(c)[i].as_py() for c in names)
                    at, term, n = (b.column(f"{c}_list")[i].values for c in ("at", "term", "n"))
                    of = lambda block: range(block * block_sources, min((block + 1) * block_sources, n_sources))  # noqa: B023, E731
                    yield from tally_block(lang, of(low), of(high), at.to_numpy(), term.dictionary_encode().indices.to_numpy(), n.to_numpy())

    return (
        keyed.repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(tally, "lang string, a int, b int, n_a long, n_b long, cells long")
        .groupBy("lang", "a", "b", "n_a", "n_b")
        .agg(F.sum("cells").alias("cells"))
    )


def tally_block(lang: str, low: range, high: range, at: np.ndarray, term: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The joint histograms of the pairs of a source of low and one of high, from the sources' terms with their counts."""
    both = [*low, *high] if low != high else [*low]
    values, code = np.unique(np.concatenate([[0], n]), return_inverse=True)
    dense = np.zeros((len(both), int(term.max()) + 1), np.int64)  # codes of counts, 0 for none
    dense[np.searchsorted(both, at), term] = code[1:]
    for i in range(len(low)):
        out = []
        for j in range(i + 1 if low == high else len(low), len(both)):
            cells, count = np.unique(dense[i] * len(values) + dense[j], return_counts=True)
            some = cells > 0  # (0, 0) is told by what is missing
            out.append((np.full(some.sum(), both[j]), values[cells[some] // len(values)], values[cells[some] % len(values)], count[some]))
        if out:
            b, n_a, n_b, count = (np.concatenate(x) for x in zip(*out, strict=True))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [[lang] * len(b), np.full(len(b), both[i]), b, n_a, n_b, count]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "a", "b", "n_a", "n_b", "cells"])


def pair_divergences(histograms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): for each source and each other one of its language, the sum of |p - q| over kept terms.

    |p - q| is worked out once for each combination of counts and taken as many times as terms have it; terms that no
    tally has are those of (0, 0). Without kept terms the value is 0.
    """
    side = lambda s: groups.select("lang", F.col("at").alias(s), F.col("total").alias(f"total_{s}"))
    sizes = groups.where("at = 0").select("lang", "terms")
    gap = F.abs(share("n_a", "total_a", "terms") - share("n_b", "total_b", "terms"))
    tallied = histograms.join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"]).join(sizes, "lang")
    sums = tallied.groupBy("lang", "a", "b").agg(F.sum(F.col("cells") * gap).alias("some"), F.sum("cells").alias("seen"))
    # the result's own rows: every source with every other of its language
    pairs = groups.select("lang", "source", "at", "total", "terms", F.explode(F.sequence(F.lit(0), (F.col("sources") - 1).cast("int"))).alias("to")).where("to <> at")
    named = groups.select("lang", F.col("at").alias("to"), F.col("source").alias("item"), F.col("total").alias("item_total"))
    pairs = pairs.join(named, ["lang", "to"]).withColumns({"a": F.least("at", "to"), "b": F.greatest("at", "to")}).join(sums, ["lang", "a", "b"], "left")
    neither = F.abs(share("0", "total", "terms") - share("0", "item_total", "terms")) * (F.col("terms") - F.coalesce("seen", F.lit(0)))
    value = F.when(F.col("terms") > 0, F.coalesce("some", F.lit(0)) + neither).otherwise(0).cast("long")
    return pairs.select("lang", "source", "item", value.alias("value"))


def over_used_terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the terms of a source whose share is above their language's, and by how much."""
    p, q = share("n", "total", "terms"), share("lang_n", "lang_total", "terms")
    return kept.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")


def audit_sources(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 30, top_terms: int = 50, block_terms: int = BLOCK_TERMS, block_sources: int = BLOCK_SOURCES
) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair``: every other source of the language by divergence; part
    ``term``: the top_terms most over-used terms. Ranked by value, the largest first, then by item in UTF-8 order.

    A language keeps the terms that at least min_docs of its documents hold; shares are 1 + floor(10^9 * (count + 5) /
    (total + 5 * terms)), over kept terms, in exact arithmetic. Null text, language and source read as ''. Every row is a
    document, repeated ones too; texts of any length are read whole; a source without kept terms has all counts 0, one
    alone in its language has no pairs; an empty table has an empty result. Columns other than the three are not read.
    """
    tables = Tables(docs.sparkSession)
    kept = tables.write(kept_counts(term_counts(docs, text=text, lang=lang, source=source), min_docs), "terms")
    groups = tables.write(source_groups(docs, kept, lang=lang, source=source), "groups")
    pairs = pair_divergences(joint_histograms(kept, groups, block_terms=block_terms, block_sources=block_sources), groups)
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(w).alias("rank"))
    result = table(ranked(pairs, "pair").unionByName(ranked(over_used_terms(kept, groups), "term").where(F.col("rank") <= top_terms)), "audit")
    tables.drop()
    return result
