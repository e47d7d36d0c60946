"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Each document expects target / size of its source copies. Within a source these expectations are summed up in a
fixed order, one random offset is added, and a document is emitted once for each whole number that its part of the
sum crosses. The order is by size, so that the sample has long and short documents in proportion and the words
taken come within about one document of the target; documents of one size follow in hashed order.

The running sum is made in three steps, none of which gathers a source in one task: sums of (source, size, slice),
sums before each size and slice, and a window within each slice. Expectations are fixed-point integers, so sums
do not depend on the order of addition and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD_REGEX, table

#: Expected copies are counted in 2**-24.
UNIT_BITS = 24
#: Documents of one source and size that one window gathers, about.
SLICE_ROWS = 256


def n_words(text: Column) -> Column:
    """Words of a whole text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def text_digest(text: Column) -> Column:
    """md5 of a whole text in hex, empty for null: it orders rows whose ids are null or repeated."""
    return F.coalesce(F.md5(text.cast("binary")), F.lit(""))


def order_hash(seed: int, *parts: Column) -> Column:
    """60 bits of md5 over seed and parts (null: empty)."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size) with target: by code point, null last, sources weigh ``weights`` in turn and share the whole size.

    A target stops at ``most`` times its source's size; the excess is shared among the others by weight until none
    is above. Sorted by limit per weight, the stopped sources are a prefix of the list, so running sums find them.
    All rows are one window: there is one row for each source, not for each document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("weight", weight.cast("double")).withColumn("limit", F.lit(most) * F.col("source_size"))
    everyone = Window.partitionBy()
    tight = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    here = tight.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(everyone) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    rows = rows.withColumn("rate", left / F.sum("weight").over(here)).withColumn("open", F.col("rate") * F.col("weight") < F.col("limit"))
    # The rate of the first source that stays below its limit holds for all after it.
    first = F.first(F.when(F.col("open"), F.col("rate")), ignorenulls=True).over(tight.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    seen = F.max("open").over(tight.rowsBetween(Window.unboundedPreceding, 0))
    target = F.when(seen, F.least(first * F.col("weight"), F.col("limit").cast("double"))).otherwise(F.col("limit").cast("double"))
    return rows.select("source", "source_size", target.alias("target"))


def copies(docs: DataFrame, *, doc_id: str, source: str, size: str, expected: str, tie: str | None = None, seed: int = 0, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Adds ``copies``, the times that systematic sampling within each source emits a row. Null expectation: 0.

    Rows of one source and size are in hashed order of id and ``tie``, so that a tie of the texts' digests makes the order
    total but for equal rows, which may change places. Other columns stay, whatever their names.
    """
    kept = [F.col(c) for c in docs.columns if c != "copies"]
    keys = [F.col(doc_id), *([F.col(tie)] if tie else [])]
    units = F.coalesce(F.round(F.col(expected) * (1 << UNIT_BITS)).cast("long"), F.lit(0))
    rows = docs.select(
        F.struct(*kept).alias("row"), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).alias("keys"),
        F.col(source).alias("source"), F.col(size).alias("size"), units.alias("units"), order_hash(seed, *keys).alias("hash"),
    )
    sizes = rows.groupBy("source", "size").agg(F.count("*").alias("n"), F.sum("units").alias("units"))
    by_size = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each distinct size of a source, as many as its longest text has words at most
    sizes = sizes.select("source", "size", F.coalesce(F.sum("units").over(by_size), F.lit(0)).alias("base"), F.ceil(F.col("n") / slice_rows).cast("int").alias("slices"))
    rows = rows.alias("r").join(sizes.alias("s"), F.expr("r.source <=> s.source AND r.size <=> s.size")).select("r.*", "base", F.shiftright(F.shiftright("hash", 28) * F.col("slices"), 32).cast("int").alias("slice"))
    slices = rows.groupBy("source", "size", "slice").agg(F.sum("units").alias("units"), F.first("base").alias("base"))
    by_slice = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("source", "size", "slice", (F.col("base") + F.coalesce(F.sum("units").over(by_slice), F.lit(0))).alias("start"))
    within = Window.partitionBy("source", "size", "slice").orderBy("hash", "keys", "units").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.drop("base").alias("r").join(slices.alias("s"), F.expr("r.source <=> s.source AND r.size <=> s.size AND r.slice = s.slice")).select("r.*", "start")
    low = F.col("start") + F.coalesce(F.sum("units").over(within), F.lit(0)) + F.shiftright(order_hash(seed, F.col("source")), 60 - UNIT_BITS)
    crossed = F.shiftright(low + F.col("units"), UNIT_BITS) - F.shiftright(low, UNIT_BITS)
    return rows.select("row", crossed.alias("copies")).select("row.*", "copies")


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of each row of docs.

    A null text has size 0; a null source is a source of its own; null and repeated ids are ordinary rows, told apart
    by their texts; rows equal in id and text are interchangeable, and are sampled one by one. Texts of any length are
    counted whole. An empty table gives an empty result; a source without words has target 0 and no copies. Rows of size 0
    in a source with words are copied at their source's rate. Columns other than the three are not read, whatever their names.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), text_digest(F.col(text)).alias("digest"))
    return mix_sized(table(sized, "sizes"), tie="digest", weights=weights, most=most, seed=seed).drop("digest")


def mix_sized(sized: DataFrame, *, tie: str | None = None, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """As mix, of rows that have doc_id, source and size; further columns stay, but those named like the three results are replaced."""
    kept = [c for c in sized.columns if c not in ("source_size", "target", "copies")]
    # columns go by their places, so that none clashes with a name used here
    at = {c: f"c{i}" for i, c in enumerate(kept)}
    rows = sized.select(*[F.col(c).alias(h) for c, h in at.items()])
    sums = rows.groupBy(F.col(at["source"]).alias("source")).agg(F.sum(at["size"]).alias("source_size"))
    goal = targets(sums, weights=weights, most=most).select(F.col("source").alias("of"), F.struct("source_size", "target").alias("goal"))
    # one row for each source; the join is left to the optimiser, which splits a hot source
    rows = rows.join(goal, F.col(at["source"]).eqNullSafe(F.col("of")), "left").select(*at.values(), "goal")
    rows = rows.withColumn("expected", F.when(F.col("goal.source_size") > 0, F.least(F.col("goal.target") / F.col("goal.source_size"), F.lit(float(most)))))
    out = copies(rows, doc_id=at["doc_id"], source=at["source"], size=at["size"], expected="expected", tie=at[tie] if tie else None, seed=seed)
    return out.select(*[F.col(h).alias(c) for c, h in at.items()], "goal.source_size", "goal.target", "copies")
