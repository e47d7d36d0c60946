"""Scores of ranked lists and answers, breakdowns in one pass, and comparisons between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.quantiles import percentiles

KS = (1, 3, 5, 10)


def first_ranks(expected: DataFrame, results: DataFrame) -> DataFrame:
    """(qid, id, rank): the best rank of each expected id, null if it was not returned."""
    best = results.groupBy("qid", "id").agg(F.min("rank").alias("rank"))
    return expected.select("qid", "id").distinct().join(best, ["qid", "id"], "left")


def question_scores(found: DataFrame, *, match: str = "any", ks: tuple[int, ...] = KS) -> DataFrame:
    """(qid, hit_k.., reciprocal): hit at k if any, or all, expected ids are within k; 1 / best rank or 0."""
    take = F.bool_or if match == "any" else F.bool_and
    hits = [take(F.coalesce(F.col("rank") <= k, F.lit(False))).alias(f"hit_{k}") for k in ks]
    return found.groupBy("qid").agg(*hits, F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("reciprocal"))


def mean(column: Column, digits: int = 6) -> Column:
    """0.0 without rows."""
    return F.round(F.coalesce(F.avg(column.cast("double")), F.lit(0.0)), digits)


def summary(scores: DataFrame, by: tuple[str, ...] = (), ks: tuple[int, ...] = KS) -> DataFrame:
    """Recall at each k and mean reciprocal rank, overall and by each of ``by``: one pass of grouping sets."""
    outs = [F.count("*").alias("questions"), *[mean(F.col(f"hit_{k}")).alias(f"recall_{k}") for k in ks], mean(F.col("reciprocal")).alias("mrr")]
    if not by:
        return scores.agg(*outs)
    sets = [[], *[[F.col(b)] for b in by]]
    return scores.groupingSets(sets, *[F.col(b) for b in by]).agg(F.grouping_id().alias("set_id"), *outs)


def context_precision(rows: DataFrame, k: int) -> DataFrame:
    """(qid, precision): mean of precision at the ranks within k that are relevant, 0 if none. rows: (qid, rank, relevant)."""
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    at = rows.where(F.col("rank") <= k).withColumn("p", F.sum(F.col("relevant").cast("int")).over(w) / F.col("rank"))
    return at.groupBy("qid").agg(F.round(F.coalesce(F.avg(F.when(F.col("relevant"), F.col("p"))), F.lit(0.0)), 6).alias("precision"))


def score_stats(rows: DataFrame, names: list[str], by: str) -> DataFrame:
    """(by, score_name, low, middle, high) of each score column, nulls skipped."""
    stacked = rows.select(by, F.explode(F.array(*[F.struct(F.lit(n).alias("score_name"), F.col(n).cast("double").alias("v")) for n in names])).alias("s")).select(by, "s.*")
    middle = percentiles(stacked, F.col("v"), [by, "score_name"], [0.5]).select(F.col(by).alias("of"), F.col("score_name").alias("of_name"), F.round(F.col("p")[0], 9).alias("middle"))
    ends = stacked.groupBy(by, "score_name").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return ends.join(middle, F.col(by).eqNullSafe(F.col("of")) & (F.col("score_name") == F.col("of_name"))).select(by, "score_name", "low", "middle", "high")


def pair_agreement(tops: DataFrame, by: str) -> DataFrame:
    """(kind, pairs, agreement): share of complete pairs with one equal, non-null top id, overall and by kind."""
    pairs = tops.groupBy("pair_id", by).agg(F.count("*").alias("n"), (F.count("top") == 2).alias("both"), (F.min("top") == F.max("top")).alias("same")).where("n = 2")
    return pairs.groupingSets([[], [F.col(by)]], F.col(by)).agg(
        F.grouping_id().alias("set_id"), F.count("*").alias("pairs"), F.round(F.avg((F.col("both") & F.coalesce("same", F.lit(False))).cast("double")), 6).alias("agreement")
    )


def fixed_broken(base: DataFrame, run: DataFrame, hit: str) -> DataFrame:
    """One row: questions of both runs, newly hit, newly missed, and the difference."""
    both = base.select("qid", F.col(hit).alias("was")).join(run.select("qid", F.col(hit).alias("now")), "qid")
    fixed, broken = F.count_if(~F.col("was") & F.col("now")), F.count_if(F.col("was") & ~F.col("now"))
    return both.agg(F.count("*").alias("questions"), fixed.alias("fixed"), broken.alias("broken"), (fixed - broken).alias("net"))


def group_deltas(both: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Hits of both runs in each group of each dimension, where they differ. both: (was, now, *by)."""
    out = both.groupingSets([[F.col(b)] for b in by], *[F.col(b) for b in by]).agg(
        F.grouping_id().alias("set_id"), F.count("*").alias("questions"), F.count_if("was").alias("base_hits"), F.count_if("now").alias("run_hits")
    )
    return out.where("base_hits <> run_hits")


def params_diff(base: DataFrame, run: DataFrame, *, derived: list[str] | None = None) -> DataFrame:
    """(key, base, run, change) of (key, value) tables: changed, added, removed; derived keys are left out."""
    joined = base.withColumnRenamed("value", "base").join(run.withColumnRenamed("value", "run"), "key", "full_outer")
    change = F.when(F.col("base").isNull(), "added").when(F.col("run").isNull(), "removed").when(F.col("base") != F.col("run"), "changed")
    out = joined.withColumn("change", change).where("change IS NOT NULL")
    return out.where(~F.col("key").isin(derived)) if derived else out


def stratified_subset(rows: DataFrame, strata: list[str], id: str, n: int) -> DataFrame:
    """Takes the i-th of each stratum in turn until n rows are taken."""
    w = Window.partitionBy(*strata).orderBy(id)
    return rows.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n).orderBy("turn", *strata, id).limit(n)


def balanced_split(questions: DataFrame, *, schema: str = "qid string, half string") -> DataFrame:
    """(qid, half) of (qid, pair_id, kind, register): pairs move together, units in order of their least id.

    Each unit goes to the half that leaves the smaller difference in its first question's kind, then over all
    registers; ``tuning`` on a tie. A choice depends on those before it only, so the fold runs over one group: an
    evaluation set of some hundreds of rows. Later ids never move earlier ones.
    """
    import pandas as pd

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("qid", kind="stable")
        lead: dict[tuple[str, str], int] = {}  # tuning's surplus of each kind and register
        out: list[tuple[str, str]] = []
        for _, unit in rows.groupby(rows["pair_id"].fillna(rows["qid"]), sort=False):
            kind = ("kind", unit["kind"].iloc[0])
            adds = [("kind", k) for k in unit["kind"]] + [("register", r) for r in unit["register"]]

            def gaps(sign: int, adds: list = adds, kind: tuple = kind) -> tuple[int, int]:
                after = dict(lead)
                for key in adds:
                    after[key] = after.get(key, 0) + sign
                return abs(after[kind]), sum(abs(v) for (name, _), v in after.items() if name == "register")

            sign = 1 if gaps(1) <= gaps(-1) else -1
            for key in adds:
                lead[key] = lead.get(key, 0) + sign
            out += [(q, "tuning" if sign == 1 else "heldout") for q in unit["qid"]]
        return pd.DataFrame(out, columns=["qid", "half"])

    return questions.withColumn("__all", F.lit(1)).groupBy("__all").applyInPandas(assign, schema)


def pick_first_per_group(rows: DataFrame, group: str, id: str, alternate: str) -> DataFrame:
    """The first row of each group; groups alternate between the two values of ``alternate`` by their order."""
    sides = rows.select(alternate).distinct().orderBy(alternate).limit(2)
    named = sides.withColumn("side", F.row_number().over(Window.orderBy(alternate)) - 1)
    groups = rows.groupBy(group).agg(F.min(id).alias("seen")).withColumn("place", F.row_number().over(Window.orderBy("seen")) - 1)
    wanted = rows.join(groups, group).join(named, alternate).where(F.pmod("place", F.lit(2)) == F.col("side"))
    return wanted.groupBy(group, alternate).agg(F.min(id).alias(id))


def answer_means(rows: DataFrame, metrics: list[str], by: str) -> DataFrame:
    """Means to 4 digits, nulls skipped, null without values: overall and by group."""
    outs = [F.round(F.avg(m), 4).alias(f"mean_{m}") for m in metrics]
    return rows.groupingSets([[], [F.col(by)]], F.col(by)).agg(F.grouping_id().alias("set_id"), F.count("*").alias("n"), *outs)


def loss_stage(gate: Column, score: Column, given: Column, refusal: Column) -> Column:
    """Where an answer lost: null for gate or unscored, else retrieval, refusal or generator."""
    return F.when(gate | score.isNull(), None).when(~given, "retrieval").when(refusal, "refusal").otherwise("generator")


def loss_attribution(rows: DataFrame) -> DataFrame:
    """(stage, lost, share) of (stage, score); share null if nothing was lost."""
    lost = rows.where("stage IS NOT NULL").groupBy("stage").agg(F.sum(1 - F.col("score")).alias("lost"))
    return lost.withColumn("share", F.round(F.try_divide("lost", F.sum("lost").over(Window.partitionBy())), 6)).withColumn("lost", F.round("lost", 6))


def expected_given(expected: Column, got: Column, match: Column) -> Column:
    subset = (F.size(F.array_except(expected, got)) == 0) & (F.size(expected) > 0)
    return F.when(match == "any", F.arrays_overlap(expected, got)).otherwise(subset)


def shared_questions(rows: DataFrame, n_runs: Column | int) -> DataFrame:
    """Ids that every run answered."""
    return rows.groupBy("qid").agg(F.count_distinct("run").alias("runs")).where(F.col("runs") == n_runs).select("qid")
