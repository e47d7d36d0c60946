"""Source divergence against dictionaries of counts."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DDL = "lang string, source string, text string"


def brute(rows, min_docs, top):
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = TERM.findall((text or "").translate(LOWER))
        n[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, k in docs[lang].items() if k >= min_docs)
        whole = sum((n[lang, s] for s in sources), Counter())

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(n[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if n[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def made(seed, n=200, sources=7):
    rng = random.Random(seed)
    words = ["the", "The", "und", "café", "猫", "x1y", "a-b", "z", "qéd", *[f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]]
    rows = []
    for _ in range(n):
        s = min(int(rng.expovariate(0.5)), sources - 1)
        text = " ".join(rng.choice(words[: 5 + 5 * s]) for _ in range(rng.randrange(30)))
        rows.append((rng.choice(["en", "de", None]), rng.choice([f"s{s}", f"s{s}", None]), rng.choice([text, text, text, None, ""])))
    return [*rows, ("en", "nothing", "12 34"), ("xx", "alone", "once"), ("yy", "a", None), ("yy", "b", "")]


@pytest.mark.parametrize(("block_terms", "block_sources"), [(4096, 32), (8, 2), (1, 1)])
def test_against_brute_force(spark, block_terms, block_sources):
    rows = made(block_terms)
    got = D.audit_sources(spark.createDataFrame(rows, DDL), min_docs=4, top_terms=5, block_terms=block_terms, block_sources=block_sources)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, 5)


def test_no_terms_means_no_difference(spark):
    rows = [("en", "a", "x"), ("en", "b", None), ("en", None, "y")]
    got = sorted(map(tuple, D.audit_sources(spark.createDataFrame(rows, DDL)).collect()))
    assert got == brute(rows, 30, 50) and len(got) == 6 and all(r[4] == 0 for r in got)


def test_counts_are_passed_on_in_bounded_tables(spark, monkeypatch):
    rows = made(3)
    want = sorted(map(tuple, D.term_counts(spark.createDataFrame(rows, DDL).coalesce(1)).collect()))
    monkeypatch.setattr(D, "HELD_TERMS", 10)
    assert sorted(map(tuple, D.term_counts(spark.createDataFrame(rows, DDL).coalesce(1)).collect())) == want


def test_joint_histograms_tally_zero_cells(spark):
    rows = made(9)
    kept = D.kept_counts(D.term_counts(spark.createDataFrame(rows, DDL)), 3).cache()
    groups = D.source_groups(spark.createDataFrame(rows, DDL), kept).cache()
    counts = {(r["lang"], r["source"], r["term"]): r["n"] for r in kept.collect()}
    at = {(r["lang"], r["at"]): r for r in groups.collect()}
    got = D.joint_histograms(kept, groups, block_terms=16, block_sources=3).collect()
    tallied = defaultdict(Counter)
    for r in got:
        assert (r["n_a"], r["n_b"]) != (0, 0) and r["a"] < r["b"]
        tallied[r["lang"], r["a"], r["b"]][r["n_a"], r["n_b"]] += r["cells"]
    for (lang, a), one in at.items():
        for b in range(a + 1, one["sources"]):
            terms = {t for g, _, t in counts if g == lang}
            want = Counter((counts.get((lang, one["source"], t), 0), counts.get((lang, at[lang, b]["source"], t), 0)) for t in terms)
            want.pop((0, 0), None)
            assert tallied[lang, a, b] == want


def test_shares_are_exact_at_any_size(spark):
    count, total, terms = 3_000_000_000_000_001, 9_000_000_000_000_000_017, 5_000_000
    row = spark.range(1).select(F.lit(count).alias("n"), F.lit(total).alias("t"), F.lit(terms).alias("v")).select(D.share("n", "t", "v").alias("p"), D.share("n", "t", "0").alias("none")).first()
    assert row["p"] == 1 + 10**9 * (count + 5) // (total + 5 * terms) and row["none"] is None


def test_odd_rows(spark):
    rows = [("en", "a", "x " * 200_000), ("en", "a", "x"), ("en", "a", "x"), ("en", "b", "\x00"), (None, None, None)] * 2
    names = ["n", "term", "at", "other", "low", "high", "key", "rank", "item", "value", "docs", "terms"]
    df = spark.createDataFrame([(*r, *["mine"] * len(names)) for r in rows], DDL + ", " + ", ".join(f"{c} string" for c in names))
    got = D.audit_sources(df, min_docs=2)
    assert sorted(map(tuple, got.collect())) == brute(rows, 2, 50)
    empty = D.audit_sources(df.limit(0))
    assert empty.columns == got.columns and empty.count() == 0
