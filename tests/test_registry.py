"""Versions and aliases, with writers that race."""

import threading

import pytest

from corpusloom.sources.registry import NotPromoted, Registry, VersionConflict


@pytest.fixture
def registry(spark, tmp_path):
    return Registry(spark, str(tmp_path / "models"))


def rows(spark, n):
    return spark.range(n).selectExpr("id", "cast(id * 2 AS string) AS text")


def test_versions_and_aliases(spark, registry):
    assert registry.latest() == 0 and registry.named("candidate") is None
    with pytest.raises(KeyError):
        registry.open("champion")
    assert registry.commit(rows(spark, 3), tags={"run": "a"}, metrics={"recall": 0.5}) == 1
    assert registry.commit(rows(spark, 5), metrics={"recall": 0.4}, alias=None) == 2
    assert registry.named("candidate") == 1 and registry.open("candidate").count() == 3 and registry.open(2).count() == 5
    assert registry.open(2).dtypes == rows(spark, 1).dtypes
    assert {r["version"]: (r["tags"], r["metrics"]) for r in registry.versions().collect()} == {1: ({"run": "a"}, {"recall": 0.5}), 2: ({}, {"recall": 0.4})}
    with pytest.raises(KeyError):
        registry.move("champion", 7)
    assert [tuple(r) for r in registry.aliases().collect()] == [("candidate", 1)]


def test_promotion(spark, registry):
    with pytest.raises(NotPromoted):
        registry.promote("recall")
    registry.commit(rows(spark, 1), metrics={"recall": 0.5})
    assert registry.promote("recall") == 1
    registry.commit(rows(spark, 2), metrics={"recall": 0.4})
    with pytest.raises(NotPromoted):
        registry.promote("recall")
    registry.commit(rows(spark, 3))
    with pytest.raises(NotPromoted):
        registry.promote("recall")
    assert registry.named("champion") == 1
    registry.commit(rows(spark, 4), metrics={"recall": 0.5})
    assert registry.promote("recall") == 4 and registry.open("champion").count() == 4
    assert registry.expire() == [1, 2, 3] and registry.expire() == [] and registry.open("champion").count() == 4
    assert registry.version(2).metrics == {"recall": 0.4}


def race(writers):
    """Runs all at once; what each gave or raised."""
    start, out = threading.Barrier(len(writers)), [None] * len(writers)

    def run(i, write):
        start.wait()
        try:
            out[i] = write()
        except Exception as e:  # noqa: BLE001
            out[i] = e

    threads = [threading.Thread(target=run, args=(i, w)) for i, w in enumerate(writers)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return out


def test_of_writers_on_one_base_one_wins(spark, registry):
    registry.commit(rows(spark, 1))
    got = race([lambda n=n: registry.commit(rows(spark, n), base=1) for n in range(2, 8)])
    won = [x for x in got if x == 2]
    assert len(won) == 1 and all(isinstance(x, VersionConflict) for x in got if x != 2)
    assert registry.latest() == 2 and registry.open(2).count() == 2 + got.index(2)
    data = registry.fs.listStatus(registry.place(f"{registry.path}/data"))
    assert len(data) == 2  # the losers left nothing
    with pytest.raises(VersionConflict):
        registry.commit(rows(spark, 1), base=1)


def test_writers_without_a_base_all_get_numbers(spark, registry):
    got = race([lambda n=n: registry.commit(rows(spark, n), alias=None) for n in range(1, 7)])
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert {registry.open(v).count() for v in got} == set(range(1, 7))


def test_readers_always_find_an_alias(spark, registry):
    for n in (1, 2):
        registry.commit(rows(spark, n))
    registry.move("champion", 1)
    seen, stop = set(), threading.Event()

    def read():
        while not stop.is_set():
            seen.add(registry.named("champion"))

    reader = threading.Thread(target=read)
    reader.start()
    for i in range(60):
        registry.move("champion", 1 + i % 2)
    stop.set()
    reader.join()
    assert seen == {1, 2}
