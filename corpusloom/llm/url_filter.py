"""URL filters: a sort-merge range join of URLs with allow and block rules.

A rule is a host and a path prefix; it fits its host and all subdomains of it. In canonical order (host labels
reversed, then path) the URLs that a rule fits at one host level form an interval, and the intervals of one host
nest. A sweep over the sorted interval ends and URLs keeps a stack of open rules: the running sum of +1 (opens)
and -1 (closes) is the stack's height, and the top at height h is the rule that opened last at height h. Both are
window functions, so that the sweep needs no Python and spills like any sort.

Hosts with many URLs are swept in several buckets, each with all rules of its host. A bucket takes at least as
many URLs as its host has rules, so the copies of rules never outnumber URLs plus rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: URLs of one host that are swept together, at least.
BUCKET_URLS = 128


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty for null or no ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def judge_urls(
    pages: DataFrame, rules: DataFrame, *, url: str = "url", prefix: str = "", default: str = "allow", bucket_urls: int = BUCKET_URLS
) -> DataFrame:
    """Adds host, path, rule and verdict to each row of pages; a rule is (host, path, verdict).

    The rule with the longest text (host and path together) wins; of equal lengths the one with the longer host.
    Of rules with one host and path ``block`` wins over ``allow``. Without a rule: rule null, verdict ``default``.
    Null URLs and those without ``://`` have an empty host and path, which no rule fits, as a rule's host is not
    empty (rules with null or empty host are dropped; a null path counts as empty). URLs of any length are read whole,
    repeated rows are judged alike, an empty table stays empty. Other columns stay, but those named like the four results
    (after ``prefix``) are replaced.
    """
    names = [f"{prefix}{x}" for x in ("host", "path", "rule", "verdict")]
    kept = [c for c in pages.columns if c not in names]
    # other columns go by their places, so that none clashes with a name used here
    held = [f"c{i}" for i in range(len(kept))]
    pages = pages.select(*[F.col(c).alias(h) for c, h in zip(kept, held, strict=True)], host_of(F.col(url)).alias("__host"), path_of(F.col(url)).alias("__path"))

    rules = (
        rules.select(
            F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("r_host"),
            F.coalesce("path", F.lit("")).alias("r_path"),
            "verdict",
        )
        .where("r_host <> '' AND verdict IS NOT NULL")
        .groupBy("r_host", "r_path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("group", reversed_host(F.col("r_host")))
    )
    # A verdict depends on host and path alone: repeated URLs are swept once.
    urls = pages.select("__host", "__path").where("__host <> ''").distinct()
    labels = F.split("__host", r"\.", -1)
    level = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda n: F.array_join(F.reverse(F.slice(labels, F.size(labels) - n + 1, n)), "."),
    )
    levels = urls.select("__host", "__path", F.explode(level).alias("group"))
    ruled = rules.groupBy("group").agg(F.count("*").alias("n_rules"))
    levels = levels.join(ruled.select("group"), "group", "left_semi")
    counts = (
        levels.groupBy("group")
        .agg(F.count("*").alias("n_urls"))
        .join(ruled, "group")
        .select("group", F.ceil(F.col("n_urls") / F.greatest(F.lit(bucket_urls), "n_rules")).cast("int").alias("buckets"))
    )

    point = levels.join(counts, "group").select(
        "group",
        F.pmod(F.xxhash64("__host", "__path"), "buckets").cast("int").alias("bucket"),
        F.col("__path").cast("binary").alias("at"),
        F.lit(0).alias("step"),
        "__host",
        "__path",
        F.lit(None).cast("struct<r_host:string,r_path:string,verdict:string>").alias("opened"),
    )
    spread = rules.join(counts, "group").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
    none = F.lit(None).cast("string")
    begin = F.col("r_path").cast("binary")
    # 0xFF is in no UTF-8 text: a rule closes after all that starts with its path.
    ends = F.array(
        F.struct(begin.alias("at"), F.lit(1).alias("step")),
        F.struct(F.concat(begin, F.lit(b"\xff")).alias("at"), F.lit(-1).alias("step")),
    )
    edges = spread.select("group", "bucket", F.explode(ends).alias("e"), F.struct("r_host", "r_path", "verdict").alias("rule")).select(
        "group",
        "bucket",
        "e.at",
        "e.step",
        none.alias("__host"),
        none.alias("__path"),
        F.when(F.col("e.step") == 1, F.col("rule")).alias("opened"),
    )

    # A rule opens before a URL at the same place; longer rules open later, as they sort after their prefixes.
    sweep = Window.partitionBy("group", "bucket").orderBy("at", F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    stack = Window.partitionBy("group", "bucket", "height").orderBy("at", F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    swept = (
        point.unionByName(edges)
        .withColumn("height", F.sum("step").over(sweep))
        .withColumn("top", F.last("opened", ignorenulls=True).over(stack))
        .where("step = 0 AND height > 0")
    )
    long = F.struct((F.length("top.r_host") + F.length("top.r_path")).alias("a"), F.length("top.r_host").alias("b"))
    best = (
        swept.groupBy("__host", "__path")
        .agg(F.max_by("top", long).alias("top"))
        .select(F.col("__host").alias("b_host"), F.col("__path").alias("b_path"), F.concat("top.r_host", "top.r_path").alias("b_rule"), F.col("top.verdict").alias("b_verdict"))
    )
    # URLs without a host have no match; however many they are, they are dealt over tasks
    dealt = pages.withColumn("__salt", F.when(F.col("__host") == "", F.spark_partition_id()).otherwise(0))
    best = best.withColumn("b_salt", F.lit(0))
    return dealt.join(best, (F.col("__host") == F.col("b_host")) & (F.col("__path") == F.col("b_path")) & (F.col("__salt") == F.col("b_salt")), "left").select(
        *[F.col(h).alias(c) for c, h in zip(kept, held, strict=True)],
        F.col("__host").alias(names[0]),
        F.col("__path").alias(names[1]),
        F.col("b_rule").alias(names[2]),
        F.coalesce("b_verdict", F.lit(default)).alias(names[3]),
    )
