"""License scans against regular expressions and recursive evaluation."""

import random
import re

import pyarrow.parquet as pq
import pytest

from corpusloom.llm import license_scan as L, queries
from tests.llm.conftest import TABLES, needs_tables

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text):
    """Words, base columns, notices that are in no longer one: window by window."""
    words = words_of(text)
    hits = []
    for n in L.NOTICES:
        phrase = n.phrase.split()
        hits += [(i, len(phrase), n) for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]
    base = [h for h in hits if h[2].base]
    within = lambda a, b: b[0] <= a[0] and a[0] + a[1] <= b[0] + b[1] and b[1] > a[1]
    kept = [h for h in hits if h[2].base or not any(within(h, o) for o in hits)]
    starts = [h[0] for h in base]
    join = lambda hs: ",".join(sorted({h[2].label for h in hs}))
    return len(words), len(base), min(starts, default=None), max(starts, default=None), join(base), join(kept), {h[2].label: h[2].weight for h in sorted(kept, key=lambda h: h[2].weight)}


@needs_tables
def test_query_against_brute_force(spark):
    rows = pq.read_table(f"{TABLES}/documents.parquet").to_pylist()
    got = {r["doc_id"]: r for r in queries.op11_license_scans(spark, TABLES).collect()}
    assert len(got) == len(rows) and any(r["n_base"] for r in got.values())
    for r in rows:
        *want, weights = brute(r["text"])
        g = got[r["doc_id"]]
        assert [g[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels")] == want
        doubt = 1.0
        for w in weights.values():
            doubt *= 1 - w
        assert g["score"] == pytest.approx(1 - doubt) and 0 <= g["score"] <= 1
        assert g["obligation"] == max((L.LICENCES[x] for x in weights), default=None)


def test_places_overlap_and_count_words():
    found = L.Scanner().scan("MIT License mit-license; xé apache\nLICENSE Lesser General Public License, MITLicense".encode())
    assert found[:6] == (12, 4, 0, 8, "apache,gpl,mit", "apache,gpl,lgpl,mit")
    assert [f[3] for f in found[8]] == ["mit", "mit", "apache", "lgpl", "gpl"]
    repeated = L.Scanner((L.Notice("a a", "x", base=True),)).scan(b"a a a A")
    assert repeated[1:4] == (3, 0, 2)


def test_random_words(spark):
    rng = random.Random(5)
    pieces = ["mit", "license", "apache", "general", "public", "lesser", "cc", "by", "nc", "sa", "all", "rights", "reserved", "grün"]
    for _ in range(300):
        text = "".join(rng.choice(pieces).upper() + rng.choice([" ", "\n", ", ", "-"]) for _ in range(rng.randrange(60)))
        *want, _ = brute(text)
        assert list(L.Scanner().scan(text.encode())[:6]) == want


@pytest.mark.parametrize(
    ("text", "obligation", "labels"),
    [
        ("MIT", 0, "mit"),
        ("gpl-2.0+", 2, "gpl"),
        ("MIT OR GPL-2.0-only", 0, "gpl,mit"),
        ("MIT AND GPL-2.0-only", 2, "gpl,mit"),
        ("MIT OR GPL-3.0-only AND CC-BY-NC-4.0", 0, "cc-by-nc,gpl,mit"),
        ("(MIT OR GPL-3.0-only) AND CC-BY-NC-4.0", 3, "cc-by-nc,gpl,mit"),
        ("GPL-2.0-only WITH Classpath-exception-2.0", 1, "gpl"),
        ("LGPL-2.1-only with Classpath-exception-2.0 and Apache-2.0", 0, "apache,lgpl"),
        ("GPL-2.0-only WITH Made-up-2.0", 2, "gpl"),
        ("LicenseRef-own", None, ""),
        ("LicenseRef-own OR MIT", 0, "mit"),
        ("LicenseRef-own AND MIT", None, "mit"),
        ("((((MIT))))", 0, "mit"),
    ],
)
def test_expressions(text, obligation, labels):
    end, value = L.parse(text)
    assert end == len(text) and value.obligation == obligation and ",".join(sorted(value.labels)) == labels


@pytest.mark.parametrize("text", ["", "(MIT", "MIT OR", "OR MIT", "(MIT OR GPL-2.0) WITH Classpath-exception-2.0", "()", "MIT WITH (x)"])
def test_broken_expressions(text):
    assert L.parse(text)[1] is None


def test_expressions_end_with_their_sentence():
    assert L.parse("MIT. Then prose")[0] == 3 and L.parse("MIT then prose")[0] == 3 and L.parse("MIT */")[0] == 3
    assert L.parse("MIT\nOR GPL-2.0")[0] == 3 and L.parse("MIT) x")[0] == 3


def test_evaluation_against_recursion():
    """Random trees, written with all parentheses and evaluated by recursion."""
    rng = random.Random(1)

    def tree(depth):
        if depth == 0 or rng.random() < 0.2:
            name = rng.choice(["MIT", "GPL-3.0-only", "MPL-2.0", "CC-BY-NC-4.0", "LicenseRef-x"])
            label = L.label_of(name)
            return name, None if label is None else L.LICENCES[label]
        op, (a, x), (b, y) = rng.choice(["and", "or"]), tree(depth - 1), tree(depth - 1)
        some = [v for v in (x, y) if v is not None]
        value = min(some, default=None) if op == "or" else max(some) if len(some) == 2 else None
        return f"({a} {op} {b})", value

    for _ in range(200):
        text, want = tree(5)
        end, value = L.parse(text)
        assert end == len(text) and value.obligation == want


def test_tags_in_texts():
    text = "// SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception\nint x;\n# spdx-license-identifier : (MIT OR\né SPDX License Identifier MIT"
    found = L.Scanner().scan(text.encode())
    assert found[9] == [(28, "Apache-2.0 WITH LLVM-exception", True, 0, ["apache"]), (text.index("(MIT"), "(MIT OR", False, None, [])]
    assert found[5] == "apache" and found[6] == pytest.approx(1 - 0.05 * 0.7) and found[7] == 0


def test_odd_rows(spark):
    texts = [None, "", " \n", "mit license", "mit license", "word " * 300_000 + "apache license", "SPDX-License-Identifier: " + "(" * 100_000, "\x00"]
    clash = ["score", "labels", "findings", "start", "words", "b"]
    df = spark.createDataFrame([(None if i % 3 else i, t, *["mine"] * len(clash)) for i, t in enumerate(texts)] * 2, "doc_id long, text string, " + ", ".join(f"{c} string" for c in clash))
    out = L.scan_licenses(df)
    got = out.collect()
    assert len(got) == 16 and all(r[c] == "mine" for r in got for c in ("start", "words", "b"))
    by_text = {r["text"]: r for r in got}
    assert [by_text[t]["n_words"] for t in (None, "", " \n", "mit license", "\x00")] == [0, 0, 0, 2, 0]
    assert by_text[None]["labels"] == "" and by_text[None]["score"] == 0 and by_text[None]["findings"] == [] and by_text[None]["first_word"] is None
    assert by_text[texts[5]]["first_word"] == 300_000 and by_text[texts[6]]["expressions"][0]["valid"] is False
    empty = L.scan_licenses(df.limit(0))
    assert empty.columns == out.columns and empty.count() == 0
