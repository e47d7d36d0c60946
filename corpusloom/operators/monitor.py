"""Operational analytics over event tables: counters, rates, histograms, drift, alerts. Batch twins of the streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.vectors import cosine
from corpusloom.operators.quantiles import percentiles
from corpusloom.operators.ranges import running

# Upper bounds of latency buckets in seconds.
LATENCY_BUCKETS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 20.0, 30.0, 60.0, 90.0, 120.0, 180.0)


def counters(events: DataFrame, labels: list[str]) -> DataFrame:
    return events.groupBy(*labels).agg(F.count("*").alias("n"))


def histogram(events: DataFrame, value: str, by: list[str], bounds: tuple[float, ...] = LATENCY_BUCKETS) -> DataFrame:
    """(by, le, n): cumulative counts, with +Inf, in one aggregation and one unpivot."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    one = events.where(F.col(value).isNotNull()).groupBy(*by).agg(*counts, F.count("*").alias("b_all"))
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit(float("inf")).alias("le"), F.col("b_all").alias("n")))
    return one.select(*by, F.inline(F.array(*rows)))


def histogram_quantile(buckets: DataFrame, q: float, by: list[str]) -> DataFrame:
    """(by, quantile): linear inside the first bucket that reaches q of all; the last finite bound beyond it."""
    w = Window.partitionBy(*by).orderBy("le")
    rows = buckets.withColumns({"low": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "below": F.coalesce(F.lag("n").over(w), F.lit(0)), "total": F.max("n").over(Window.partitionBy(*by))})
    hit = rows.where((F.col("n") >= q * F.col("total")) & (F.col("total") > 0))
    first = hit.groupBy(*by).agg(F.min_by(F.struct("le", "low", "n", "below", "total"), "le").alias("h"))
    inside = F.col("h.low") + (F.col("h.le") - F.col("h.low")) * F.coalesce(F.try_divide(q * F.col("h.total") - F.col("h.below"), F.col("h.n") - F.col("h.below")), F.lit(1.0))
    return first.select(*by, F.round(F.when(F.col("h.le") == float("inf"), F.col("h.low")).otherwise(inside), 9).alias("quantile"))


def sliding_rate(events: DataFrame, ts: str, by: list[str], *, length: str = "5 minutes", slide: str = "1 minute", seconds: int = 300) -> DataFrame:
    """(by, window_start, rate per second) over sliding windows."""
    out = events.groupBy(F.window(ts, length, slide).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(*by, F.col("w.start").alias("window_start"), F.round(F.col("n") / F.lit(float(seconds)), 9).alias("rate"))


def timing(events: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean and inclusive percentiles; groups of fewer than two values are left out."""
    found = percentiles(events, F.col(value), by, [0.5, 0.95, 0.99]).where("n >= 2")
    means = events.groupBy(*[F.col(c).alias(f"of_{c}") for c in by]).agg(F.round(F.avg(value), 6).alias("mean"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in by], F.lit(True))
    return found.join(means, same).select(*by, "n", "mean", *[F.round(F.col("p")[i], 6).alias(name) for i, name in enumerate(("p50", "p95", "p99"))])


def centroid(vectors: DataFrame, vector: str) -> DataFrame:
    """One row: the component-wise mean, not normalised. Partial sums per component, no gathering of vectors."""
    means = vectors.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def drift_baseline(vectors: DataFrame, vector: str) -> DataFrame:
    """One row: centroid, n, mean and sample standard deviation of cosines to it; no row under two vectors."""
    near = vectors.crossJoin(F.broadcast(centroid(vectors, vector))).select("centroid", cosine(F.col(vector), F.col("centroid")).alias("c"))
    return near.groupBy("centroid").agg(F.count("*").alias("n"), F.avg("c").alias("mean"), F.stddev_samp("c").alias("std")).where("n >= 2")


def drift_windows(vectors: DataFrame, baseline: DataFrame, *, vector: str, order: str, by: list[str], last: int = 20, range_size: int = 65_536) -> DataFrame:
    """Adds ratio (mean cosine of the last rows over the baseline's) and line (1 - 3 std / (mean sqrt(n)), n the rows so far).

    ``order`` is a number. A group's rows are dealt to ranges of it, each of which also has the last rows before it, so that
    no group is one window; only those last rows, a fixed number a range, meet in a window by group.
    """
    # the baseline is one row
    rows = vectors.crossJoin(F.broadcast(baseline.select("centroid", F.col("mean").alias("b_mean"), F.col("std").alias("b_std"))))
    rows = rows.select(*by, F.col(order).alias("o"), F.floor(F.col(order) / range_size).alias("range"), cosine(F.col(vector), F.col("centroid")).alias("c"), "b_mean", "b_std")
    newest = Window.partitionBy(*by, "range").orderBy(F.desc("o"))
    tails = rows.withColumn("n", F.row_number().over(newest)).where(F.col("n") < last).groupBy(*by, "range").agg(F.collect_list(F.struct("o", "c")).alias("tail"), F.first("b_mean").alias("b_mean"), F.first("b_std").alias("b_std"))
    before = Window.partitionBy(*by).orderBy("range").rowsBetween(1 - last, -1)  # a range has a row at least
    carried = tails.withColumn("all", F.sort_array(F.flatten(F.collect_list("tail").over(before)), asc=False))
    carried = carried.select(*by, "range", F.explode(F.slice("all", 1, last - 1)).alias("x"), "b_mean", "b_std").select(*by, F.col("x.o").alias("o"), "range", F.col("x.c").alias("c"), "b_mean", "b_std", F.lit(False).alias("real"))
    w = Window.partitionBy(*by, "range").orderBy("o").rowsBetween(1 - last, 0)
    out = rows.withColumn("real", F.lit(True)).unionByName(carried)
    ratio, line = F.avg("c").over(w) / F.col("b_mean"), 1 - 3 * F.col("b_std") / (F.col("b_mean") * F.sqrt(F.count("*").over(w)))
    return out.select(*by, F.col("o").alias(order), F.round(ratio, 6).alias("ratio"), F.round(line, 6).alias("line"), "real").where("real").drop("real")


def breaches(rows: DataFrame, ts: str, by: list[str], broken: Column, *, seconds: int) -> DataFrame:
    """(by, breach_start, breach_end): runs of broken rows that last at least so long; a key's rows are taken day by day."""
    flagged = rows.withColumn("broken", F.coalesce(broken, F.lit(False)))
    day = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / 86_400)
    runs = running(flagged, by, [ts], day, sums={"run": (~F.col("broken")).cast("int")})
    out = runs.where("broken").groupBy(*by, "run").agg(F.min(ts).alias("breach_start"), F.max(ts).alias("breach_end")).drop("run")
    return out.where(F.unix_timestamp(F.col("breach_end").cast("timestamp")) - F.unix_timestamp(F.col("breach_start").cast("timestamp")) >= seconds)


def canary(id: Column, share: int) -> Column:
    """``stable`` for the given percentage of ids, by md5."""
    part = F.conv(F.substring(F.md5(id.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return F.when(part % 100 < share, "stable").otherwise("canary")


def hash_sample(rows: DataFrame, id: str, n: int, seed: str) -> DataFrame:
    """n rows by md5 of seed and id: the same ones on each run and in each engine."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")).cast("binary"))
    return rows.orderBy(key, id).limit(n)


def latest(rows: DataFrame, by: str, ts: str, columns: list[str]) -> DataFrame:
    """The newest row of each group, ties to the larger values."""
    return rows.groupBy(by).agg(F.max(F.struct(ts, *columns)).alias("r")).select(by, "r.*")


def span_rollup(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, n_children, total, own): a span's length and what its direct children leave of it, not below 0.

    spans: (trace_id, span_id, parent_id, began, ended) in seconds. A child whose parent is not there is a root.
    """
    length = F.col("ended") - F.col("began")
    inner = spans.where("parent_id IS NOT NULL").groupBy("trace_id", F.col("parent_id").alias("span_id")).agg(F.count("*").alias("n_children"), F.sum(length).alias("inner"))
    out = spans.select("trace_id", "span_id", length.alias("total")).join(inner, ["trace_id", "span_id"], "left")
    return out.select("trace_id", "span_id", F.coalesce("n_children", F.lit(0)).alias("n_children"), "total", F.greatest(F.col("total") - F.coalesce("inner", F.lit(0)), F.lit(0)).alias("own"))


def observed(rows: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """The rows, whose metrics an observation or a streaming listener gets once they are read; nothing else is read for it."""
    return rows.observe(name, *[c.alias(k) for k, c in metrics.items()])
