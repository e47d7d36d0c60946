import random

from corpusloom.llm.url_filter import judge_urls

RULES = "host string, path string, verdict string"


def brute(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([i for c in "?#" if (i := path.find(c)) >= 0], default=len(path))]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_against_brute_force(spark):
    rng = random.Random(5)
    hosts, parts = ["com", "a.com", "b.a.com", "net", "x.net", "é.org"], ["", "/", "/a", "/a/b", "/ab", "/a/bé", "/b?x#y", "#z", "?q"]
    rules = sorted({(h, p): (h, p, rng.choice(["allow", "block"])) for h in hosts for p in ("/", "/a", "/a/", "/a/b", "/ab", "") if rng.random() < 0.5}.values())
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['', 'www.', 'W.'])}{rng.choice(hosts)}{rng.choice(parts)}{rng.choice(['', '1', '/b'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "http://", "http:///a", "x://com\n/a", "http://COM/a", "http://.com/a", "http://com./a"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = judge_urls(rows, spark.createDataFrame(rules, RULES), bucket_urls=7).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(urls[r["page_id"]], rules), urls[r["page_id"]]


def test_repeats_clashes_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, "http://a.com/x", "old", 1), (None, "http://a.com/x", "old", 1)], "page_id int, url string, verdict string, bucket int")
    rules = spark.createDataFrame([("com", None, "allow"), ("com", "", "block"), (None, "/", "block"), ("", "/", "block"), ("A.com", "/x", "block"), ("b.com", "/", None)], RULES)
    out = judge_urls(rows, rules)
    assert sorted(out.columns) == ["bucket", "host", "page_id", "path", "rule", "url", "verdict"]
    assert [(r["rule"], r["verdict"], r["bucket"]) for r in out.collect()] == [("a.com/x", "block", 1)] * 2
    assert judge_urls(rows, rules.limit(0)).first()["verdict"] == "allow"
    assert judge_urls(rows.limit(0), rules).count() == 0


def test_long_path(spark):
    path = "/" + "é" * 200_000
    out = judge_urls(spark.createDataFrame([(1, f"http://a.com{path}")], "page_id int, url string"), spark.createDataFrame([("com", path, "block")], RULES)).head()
    assert out["verdict"] == "block"


def test_all_helper_names_may_be_columns(spark):
    names = ["b_host", "b_rule", "b_verdict", "b_path", "b_salt", "__host", "__path", "__salt", "group", "bucket", "c0", "c1", "height", "top", "step", "opened", "n_urls", "r_host"]
    rows = spark.createDataFrame([("http://a.com/x", *names)], "url string, " + ", ".join(f"`{n}` string" for n in names))
    row = judge_urls(rows, spark.createDataFrame([("com", "/", "block")], RULES)).first()
    assert all(row[n] == n for n in names) and (row["host"], row["rule"], row["verdict"]) == ("a.com", "com/", "block")
