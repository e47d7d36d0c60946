"""Exact percentiles of groups of any size: a sketch brackets them, counts settle them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group that are sorted whole; beyond that a sketch of this accuracy brackets each percentile.
ACCURACY = 10_000


def percentiles(rows: DataFrame, value: Column, by: list[str], qs: list[float], *, accuracy: int = ACCURACY) -> DataFrame:
    """(by, n, p): inclusive percentiles by linear interpolation between neighbours, as an array in order of qs; nulls are skipped.

    A mergeable sketch of bounded size gives values that are surely below and above each percentile: some 6 / accuracy of a
    group's rows lie between. Values below are counted, those between are counted by value, and only these distinct values
    are put in order: no task holds a group. A group without values has n 0 and null percentiles.
    """
    names = [f"g{i}" for i in range(len(by))]
    v = rows.select(*[F.col(c).alias(g) for c, g in zip(by, names, strict=True)], value.cast("double").alias("v"))
    margin = 3 / accuracy
    around = F.array(*[F.lit(min(max(x, 0.0), 1.0)) for q in qs for x in (q - margin, q + margin)])
    stats = v.groupBy(*names).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.percentile_approx("v", around, accuracy).alias("near"))
    whole = F.col("n") <= accuracy
    bracket = [F.struct(F.lit(i).alias("i"), F.when(whole, F.col("low")).otherwise(F.col("near")[2 * i]).alias("a"), F.when(whole, F.col("high")).otherwise(F.col("near")[2 * i + 1]).alias("b")) for i in range(len(qs))]
    bounds = stats.select(*[F.col(g).alias(f"of_{g}") for g in names], "n", F.array(*bracket).alias("brackets"))
    same = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"of_{g}")) for g in names], F.lit(True))
    # one row a group
    found = v.where("v IS NOT NULL").join(bounds, same).select(*names, "n", "v", F.explode("brackets").alias("k"))
    # below the bracket only the number counts, all under one value
    placed = found.where(F.col("v") <= F.col("k.b")).groupBy(*names, "n", F.col("k.i").alias("i"), F.when(F.col("v") >= F.col("k.a"), F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    order = Window.partitionBy(*names, "i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    h = F.element_at(F.array(*map(F.lit, qs)), F.col("i") + 1) * (F.col("n") - 1)
    ranked = placed.withColumns({"upto": F.sum("c").over(order), "h": h})
    at = lambda j: F.min(F.when(F.col("upto") >= j, F.col("v")))
    j = F.floor("h") + 1
    pair = ranked.groupBy(*names, "n", "i", "h").agg(at(j).alias("x"), at(j + 1).alias("y"))
    one = pair.select(*names, "i", (F.col("x") + (F.col("h") - F.floor("h")) * (F.coalesce("y", "x") - F.col("x"))).alias("p"))
    listed = one.groupBy(*names).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "p"))), lambda s: s["p"]).alias("p"))  # one value a percentile
    out = bounds.select(*[F.col(f"of_{g}").alias(c) for g, c in zip(names, by, strict=True)], "n").alias("s")
    listed = listed.select(*[F.col(g).alias(f"at_{g}") for g in names], "p")
    match = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"at_{g}")) for g, c in zip(names, by, strict=True)], F.lit(True))
    return out.join(listed, match, "left").select(*by, "n", "p")
