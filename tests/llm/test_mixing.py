import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm.mixing import copies, mix, mix_sized, targets


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Resharing the excess round by round."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in stopped]
        left = total - sum(stopped.values())
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return {**stopped, **share}
        stopped |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(4))
def test_targets_against_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = {rng.choice([f"s{i}", f"é{i}"]): rng.choice([0, 1, 10, 200, 5000]) for i in range(12)} | {None: rng.choice([0, 70]), "big": 4000}
    got = {r["source"]: r["target"] for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == {s: pytest.approx(t) for s, t in brute_targets(sizes).items()}


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([1, 5, 5, 5, 40, 300]), rng.choice(["hot"] * 6 + ["a", "b", None])) for i in range(4000)]
    rows += [(1, None, "a"), (None, "x y", "b"), (None, "x y", "b"), (7, "", "only empty"), (9, "x", "tiny")]
    df = spark.createDataFrame([(*r, -1, "old") for r in rows], "doc_id long, text string, source string, size int, target string")
    out = mix(df).collect()
    assert len(out) == len(rows)
    taken, goal = {}, {}
    for r in out:
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
        goal[r["source"]] = r["target"]
    for s, t in goal.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 301 * 2)
    again = mix(df.repartition(7)).collect()
    key = lambda r: repr(sorted(r.asDict().items(), key=str))
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_emission_follows_the_running_sum(spark):
    rows = [(i, "s", 5, 0.37) for i in range(1000)] + [(i, "t", i % 7, 2.5) for i in range(100)] + [(i, "n", 1, None) for i in range(5)]
    out = copies(spark.createDataFrame(rows, "doc_id long, source string, size int, expected double"), doc_id="doc_id", source="source", size="size", expected="expected", slice_rows=16)
    got = {r["source"]: r for r in out.groupBy("source").agg(F.sum("copies").alias("n"), F.min("copies").alias("low"), F.max("copies").alias("high")).collect()}
    assert abs(got["s"]["n"] - 370) <= 1 and (got["s"]["low"], got["s"]["high"]) == (0, 1)
    assert abs(got["t"]["n"] - 250) <= 1 and (got["t"]["low"], got["t"]["high"]) == (2, 3)
    assert got["n"]["n"] == 0


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    one = mix(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).head()
    assert (one["size"], one["target"], one["copies"]) == (0, 0.0, 0)


def test_clashing_columns_stay(spark):
    helpers = ["row", "keys", "units", "hash", "base", "slices", "slice", "start", "source_size", "target", "copies", "n", "__hash"]
    rows = [(i, f"s{i % 3}", i % 5, *["mine"] * len(helpers)) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, " + ", ".join(f"`{h}` string" for h in helpers))
    out = mix_sized(df)
    assert out.columns == ["doc_id", "source", "size", *[h for h in helpers if h not in ("source_size", "target", "copies")], "source_size", "target", "copies"]
    assert out.where("base = 'mine' AND start = 'mine' AND row = 'mine' AND copies <= 3").count() == 50


def test_reruns_of_null_and_repeated_ids_agree(spark):
    """The digest orders rows whose ids do not."""
    rows = [(None if i % 2 else 5, "a" if i % 3 else None, 3, f"digest{i // 2}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, digest string")
    once, again = (mix_sized(x, tie="digest").groupBy("doc_id", "source", "digest").agg(F.sort_array(F.collect_list("copies")).alias("c")).collect() for x in (df, df.orderBy(F.rand(3)).repartition(7)))
    assert sorted(map(str, once)) == sorted(map(str, again))


def test_null_ids_are_dealt_over_slices(spark):
    """With the digest no slice holds all rows of a null id."""
    from corpusloom.llm.mixing import order_hash

    rows = spark.range(4000).select(order_hash(0, F.lit(None).cast("long"), F.md5(F.col("id").cast("string").cast("binary"))).alias("h"))
    assert rows.select(F.shiftright(F.shiftright("h", 28) * 16, 32).alias("slice")).groupBy("slice").count().where("count < 400").count() == 16


def test_very_long_text(spark):
    long = "word " * 2_000_000
    out = {r["doc_id"]: r for r in mix(spark.createDataFrame([(1, long, "a"), (2, "x y", "b")], "doc_id long, text string, source string")).collect()}
    assert out[1]["size"] == 2_000_000 and out[2]["target"] == 6.0


def test_all_helper_names_may_be_columns(spark):
    from corpusloom.llm import mixing

    names = ["__of", "__goal", "__expected", "of", "goal", "expected", "row", "keys", "units", "hash", "slice", "base", "start", "c0", "c1", "k0", "slices"]
    rows = spark.createDataFrame([(i, "ab"[i % 2], 5 + i, *names) for i in range(20)], "doc_id long, source string, size long, " + ", ".join(f"`{n}` string" for n in names))
    got = mixing.mix_sized(rows)
    plain = {r["doc_id"]: r for r in mixing.mix_sized(rows.select("doc_id", "source", "size")).collect()}
    assert got.columns == ["doc_id", "source", "size", *names, "source_size", "target", "copies"]
    for r in got.collect():
        assert all(r[n] == n for n in names) and r["copies"] == plain[r["doc_id"]]["copies"]
