"""Data-quality checks as rows (check_id, passed, value), and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def check_rows(row: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row of aggregates to one row per check: (passed, value) by id."""
    made = [F.struct(F.lit(k).alias("check_id"), p.alias("passed"), v.cast("double").alias("value")) for k, (p, v) in checks.items()]
    return row.select(F.inline(F.array(*made)))


def require(checks: DataFrame) -> None:
    """Raises if a check failed; call it after outputs are written."""
    failed = [r["check_id"] for r in checks.where("NOT passed").orderBy("check_id").collect()]  # one row a check
    if failed:
        raise ValueError(f"checks failed: {', '.join(failed)}")


def iqr_outliers(rows: DataFrame, value: str, by: str) -> DataFrame:
    """(by, n, q1, q3, low, high, n_outliers): exclusive quartiles, bounds at 1.5 interquartile ranges.

    Quartiles need two order statistics each. Values are counted first, so what is sorted per group is its distinct
    values with counts, a few thousand for lengths, not its rows.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"upto": F.sum("c").over(w), "n": F.sum("c").over(Window.partitionBy(by))})

    def at(i: Column) -> Column:
        return F.min(F.when(F.col("upto") >= i, F.col("v")))

    def quartile(q: float) -> Column:
        h = F.lit(q) * (F.col("n") + 1)
        return F.greatest(F.lit(1), F.least(F.floor(h), F.col("n") - 1))

    places = placed.withColumns({"j1": quartile(0.25), "j3": quartile(0.75)})
    found = places.groupBy(by, "n", "j1", "j3").agg(at(F.col("j1")).alias("a1"), at(F.col("j1") + 1).alias("b1"), at(F.col("j3")).alias("a3"), at(F.col("j3") + 1).alias("b3"))
    q1 = F.col("a1") + (0.25 * (F.col("n") + 1) - F.col("j1")) * (F.col("b1") - F.col("a1"))
    q3 = F.col("a3") + (0.75 * (F.col("n") + 1) - F.col("j3")) * (F.col("b3") - F.col("a3"))
    bounds = found.where("n >= 2").select(by, "n", q1.alias("q1"), q3.alias("q3")).withColumns({"low": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), "high": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    out = counts.join(bounds, by).groupBy(by, "n", "q1", "q3", "low", "high").agg(F.sum(F.when((F.col("v") < F.col("low")) | (F.col("v") > F.col("high")), F.col("c")).otherwise(0)).alias("n_outliers"))
    return out


def number_gaps(rows: DataFrame, number: str, *, known: DataFrame | None = None) -> DataFrame:
    """(number, problem): missing from 1..max unless known, or present more than once."""
    counts = rows.groupBy(F.col(number).cast("long").alias("v")).agg(F.count("*").alias("times"))
    top = rows.agg(F.max(number).alias("top")).head()["top"]
    missing = rows.sparkSession.range(1, int(top or 0) + 1).withColumnRenamed("id", "v").join(counts, "v", "left_anti")  # made in parts, as it is read
    if known is not None:
        missing = missing.join(known.select(F.col(number).cast("long").alias("v")), "v", "left_anti")
    twice = counts.where("times > 1").select("v", F.lit("duplicate").alias("problem"))
    return missing.select("v", F.lit("missing").alias("problem")).unionByName(twice).withColumnRenamed("v", number)


def id_mismatches(left: DataFrame, right: DataFrame, id: str) -> DataFrame:
    """(id, side): in one table only."""
    a = left.select(id).distinct().join(right, id, "left_anti").select(id, F.lit("left").alias("side"))
    return a.unionByName(right.select(id).distinct().join(left, id, "left_anti").select(id, F.lit("right").alias("side")))


def character_error_rate(rows: DataFrame, got: str, gold: str) -> DataFrame:
    """One row: edits, gold characters, rate; 1.0 without gold text."""
    edits = F.coalesce(F.sum(F.levenshtein(got, gold)), F.lit(0)).cast("long")
    size = F.coalesce(F.sum(F.length(gold)), F.lit(0)).cast("long")
    return rows.agg(edits.alias("edits"), size.alias("gold_chars")).withColumn("cer", F.coalesce(F.try_divide("edits", "gold_chars"), F.lit(1.0)))


def accepted(text: Column, span: Column, replacement: Column) -> Column:
    """Replaces a span only where it occurs exactly once."""
    n = F.try_divide(F.length(text) - F.length(F.replace(text, span, F.lit(""))), F.length(span))
    return F.when(n == 1, F.replace(text, span, replacement)).otherwise(text)


def eval_set_problems(questions: DataFrame) -> DataFrame:
    """(key, problem): repeated ids; pairs that are not one Arabic and one English question of one kind."""
    twice = questions.groupBy("qid").agg(F.count("*").alias("n")).where("n > 1").select(F.col("qid").alias("key"), F.lit("duplicate id").alias("problem"))
    pairs = questions.where("pair_id IS NOT NULL").groupBy("pair_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"), F.count_distinct("kind").alias("kinds"))
    bad = pairs.where("n <> 2 OR languages <> 'ar,en' OR kinds <> 1").select(F.col("pair_id").alias("key"), F.lit("bad pair").alias("problem"))
    return twice.unionByName(bad)


def questions_lost(base: Column, now: Column, questions: Column) -> Column:
    """A drop in recall as a number of questions, half to even."""
    return F.bround((base - now) * questions, 0)


def ci_gate(row: DataFrame, *, min_faithfulness: float, max_drop: int) -> DataFrame:
    """Adds faithful_ok, recall_state (pass, fail, skip) and passed to a row of subset, scored, ci_size, faithfulness,
    split, recall, questions, base_split, base_recall."""
    ok = (F.col("subset") == "ci") & (F.col("scored") == F.col("ci_size")) & F.coalesce(F.col("faithfulness") >= min_faithfulness, F.lit(False))
    drop = questions_lost(F.col("base_recall"), F.col("recall"), F.col("questions"))
    state = F.when(~F.col("split").eqNullSafe("tuning"), "fail").when(~F.col("base_split").eqNullSafe("tuning"), "skip").when(drop <= max_drop, "pass").otherwise("fail")
    return row.withColumns({"faithful_ok": F.coalesce(ok, F.lit(False)), "recall_state": state}).withColumn("passed", F.col("faithful_ok") & (F.col("recall_state") != "fail"))


def promotion(candidate: Column, production: Column) -> Column:
    """A finite score in 0..1 that is at least the one in production."""
    sound = candidate.isNotNull() & ~F.isnan(candidate) & candidate.between(0, 1)
    return F.coalesce(sound & (production.isNull() | (candidate >= production)), F.lit(False))


def profile_gates(facts: DataFrame, expected: dict[str, float]) -> DataFrame:
    """(gate, expected, actual, passed) of one row of facts: each that is named must have its value; a missing one fails."""
    absent = F.lit(None).cast("double")
    gates = [
        F.struct(F.lit(k).alias("gate"), F.lit(float(v)).alias("expected"), (F.col(k).cast("double") if k in facts.columns else absent).alias("actual"))
        for k, v in expected.items()
    ]
    return facts.select(F.inline(F.array(*gates))).withColumn("passed", F.coalesce(F.col("actual") == F.col("expected"), F.lit(False)))


# What settings must look like.
SETTING_PATTERNS = {"experiment": r"^[a-z0-9][a-z0-9._-]*$", "revision": r"^[0-9a-f]{40}$", "url": r"^https?://\S+$", "bucket": r"^[a-z0-9][a-z0-9.-]{1,61}[a-z0-9]$"}


def setting_problems(settings: DataFrame) -> DataFrame:
    """(name, problem) of (name, kind, value): values that do not fit their kind; kinds are those of SETTING_PATTERNS, ``path`` and ``text``.

    A path is relative and stays inside its root; a text is not blank.
    """
    value = F.col("value")
    fits = F.when(F.col("kind") == "path", ~value.startswith("/") & ~F.array_contains(F.split(value, "/"), ".."))
    fits = fits.when(F.col("kind") == "text", F.trim(value) != "")
    for kind, pattern in SETTING_PATTERNS.items():
        fits = fits.when(F.col("kind") == kind, value.rlike(pattern))
    known = [*SETTING_PATTERNS, "path", "text"]
    problem = F.when(~F.col("kind").isin(known), "unknown kind").when(value.isNull(), "missing").when(~fits, F.concat(F.lit("no "), F.col("kind")))
    return settings.select("name", problem.alias("problem")).where("problem IS NOT NULL")


def check_endpoints(generator: dict[str, str | None], judge: dict[str, str | None]) -> None:
    """Raises if a setting of either is missing, naming all, or if the judge is the generator, which would grade itself."""
    missing = [f"{who}.{k}" for who, found in (("generator", generator), ("judge", judge)) for k, v in found.items() if not v]
    if missing:
        raise ValueError(f"not set: {', '.join(missing)}")
    if generator.get("model") == judge.get("model"):
        raise ValueError(f"{judge.get('model')} is both generator and judge")


def judged(rows: DataFrame, reply: str, metrics: list[str]) -> DataFrame:
    """Adds each metric from a judge's JSON reply; null where the judge failed: no JSON, no number, or none in 0..1."""
    parsed = F.try_parse_json(F.col(reply))
    number = lambda m: F.try_variant_get(parsed, f"$.{m}", "double")
    return rows.withColumns({m: F.when(number(m).between(0, 1), number(m)) for m in metrics})


class CountsWrong(ValueError):
    """Rows were written whose counts are not what they must be."""


def written_with_counts(rows: DataFrame, path: str, counts: dict[str, Column], limits: dict[str, tuple[float, float]] | None = None) -> dict[str, int]:
    """Writes the rows and counts them on the way, in one pass: an aggregate for each name, observed while rows are written.

    limits: the least and the most that a count may be; those that are not are raised together once all is written, so
    that what was extracted can be looked at.
    """
    from pyspark.sql import Observation

    seen = Observation()
    rows.observe(seen, *[c.alias(n) for n, c in counts.items()]).write.mode("overwrite").parquet(path)
    found = {n: seen.get[n] for n in counts}
    wrong = {n: found[n] for n, (low, high) in (limits or {}).items() if found[n] is None or not low <= found[n] <= high}
    if wrong:
        raise CountsWrong(f"{path}: " + ", ".join(f"{n} is {v}" for n, v in sorted(wrong.items())))
    return found
