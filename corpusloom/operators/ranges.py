"""Running values over long keys: windows over ranges of a key's rows, and what each range takes over from those before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(
    rows: DataFrame, by: list[str], order: list[str], span: Column, *, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, lags: dict[str, Column] | None = None, leads: dict[str, Column] | None = None
) -> DataFrame:
    """Adds columns that a window over a key's rows in order would give, without one key in one task.

    span numbers the ranges of a key and must not fall along the order. sums and maxima run up to the row, lasts are the last
    values that are not null, lags and leads the values of the rows before and after. Rows are ordered within their range; each range also gives
    one row with its totals, and only these rows meet by key. The order must be total within a key; rows are read twice.
    """
    kinds = {"s": sums or {}, "l": lasts or {}, "m": maxima or {}, "b": lags or {}, "a": leads or {}}
    at = F.struct(*order)
    held = {f"__{k}_{n}": c for k, named in kinds.items() for n, c in named.items()}
    rows = rows.withColumn("__span", F.coalesce(span.cast("long"), F.lit(-(1 << 62)))).withColumns(held)
    names = lambda k: [(n, f"__{k}_{n}") for n in kinds[k]]

    totals = rows.groupBy(*by, "__span").agg(
        F.count("*").alias("__rows"),
        *[F.sum(h).alias(h) for _, h in names("s")],
        *[F.max_by(F.struct(h), F.when(F.col(h).isNotNull(), at)).alias(h) for _, h in names("l")],
        *[F.max(h).alias(h) for _, h in names("m")],
        *[F.max_by(F.struct(h), at).alias(h) for _, h in names("b")],
        *[F.min_by(F.struct(h), at).alias(h) for _, h in names("a")],
    )
    key = Window.partitionBy(*by).orderBy("__span")
    before = key.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(c).alias(f"__of_{c}") for c in by],
        F.col("__span").alias("__of_span"),
        *[F.sum(h).over(before).alias(f"__c{h}") for _, h in names("s")],
        *[F.last(h, ignorenulls=True).over(before)[h].alias(f"__c{h}") for _, h in names("l")],
        *[F.max(h).over(before).alias(f"__c{h}") for _, h in names("m")],
        *[F.lag(h).over(key)[h].alias(f"__c{h}") for _, h in names("b")],
        *[F.lead(h).over(key)[h].alias(f"__c{h}") for _, h in names("a")],
    )
    here = Window.partitionBy(*by, "__span").orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns(
        {
            **{f"__w{h}": F.sum(h).over(upto) for _, h in names("s")},
            **{f"__w{h}": F.last(F.when(F.col(h).isNotNull(), F.struct(h)), ignorenulls=True).over(upto)[h] for _, h in names("l")},
            **{f"__w{h}": F.max(h).over(upto) for _, h in names("m")},
            **{f"__w{h}": F.lag(h).over(here) for _, h in names("b")},
            **{f"__w{h}": F.lead(h).over(here) for _, h in names("a")},
            "__first": F.lag(F.lit(1)).over(here).isNull(),
            "__last": F.lead(F.lit(1)).over(here).isNull(),
        }
    )
    same = F.col("__span") == F.col("__of_span")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    # one row a range; the optimiser broadcasts it or splits what is hot
    joined = local.join(carried, same)
    out = {
        **{n: F.coalesce(F.col(f"__w{h}"), F.lit(0)) + F.coalesce(F.col(f"__c{h}"), F.lit(0)) for n, h in names("s")},
        **{n: F.coalesce(f"__w{h}", f"__c{h}") for n, h in names("l")},
        **{n: F.greatest(f"__w{h}", f"__c{h}") for n, h in names("m")},
        **{n: F.when(F.col("__first"), F.col(f"__c{h}")).otherwise(F.col(f"__w{h}")) for n, h in names("b")},
        **{n: F.when(F.col("__last"), F.col(f"__c{h}")).otherwise(F.col(f"__w{h}")) for n, h in names("a")},
    }
    kept = [c for c in rows.columns if c not in held and c != "__span" and c not in out]
    return joined.select(*kept, *[c.alias(n) for n, c in out.items()])
