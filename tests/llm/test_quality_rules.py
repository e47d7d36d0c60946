import os
import random
import string
from collections import Counter

import pytest
import zstandard

from corpusloom.llm.quality_rules import BANDS, CHUNK, CHUNK_HIGH, LEVEL, apply_rules, base_counts, ratios, repeat_words, verdict


def brute(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if __import__("re").search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_counts_against_brute_force():
    rng = random.Random(9)
    pieces = ["a", "bé", "c#", "<d>", "\n", "\n\n", "\t", "\x0b", "\u00a0", "\u2028", "x y", "|", "the same eight words come here again now then"]
    for _ in range(300):
        text = "".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randint(0, 60)))
        assert base_counts(text.encode()) == brute(text)


def test_overlapping_windows():
    assert repeat_words([b"a"] * 8) == 0
    assert repeat_words([b"a"] * 9) == 9
    assert repeat_words([]) == 0


def test_verdicts_and_edges(spark):
    rng = random.Random(1)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(400))
    half = " ".join(f"{w} {w}x {w}y" for w in ["abc"] * 2000)
    rows = [(1, None), (2, ""), (3, " \n "), (4, prose), (5, "word " * 3000), (6, os.urandom(4000).hex() + " " + " ".join(map(str, range(30)))), (7, prose), (None, prose), (8, half), (9, "é" * 300_000)]
    df = spark.createDataFrame([(*r, "old", 1.5) for r in rows], "doc_id int, text string, reason string, ratio double")
    out = apply_rules(df).collect()
    got = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows)
    assert [got[i]["n_words"] for i in (1, 2, 3)] == [0, 0, 0] and all(got[i]["base_failed"] and not got[i]["kept"] for i in (1, 2, 3))
    assert got[1]["ratio"] is None
    assert got[4]["kept"] and got[None]["kept"] and got[7]["kept"]
    assert got[5]["reason"] == "repetitive" and got[5]["base_failed"]
    assert got[9]["reason"] == "repetitive" and not got[9]["kept"]
    assert apply_rules(df.limit(0)).count() == 0


def test_random_bytes_are_incompressible(spark):
    import base64

    text = " ".join(base64.b85encode(os.urandom(60)).decode() for _ in range(200))
    assert apply_rules(spark.createDataFrame([(1, text)], "doc_id int, text string")).head()["reason"] == "incompressible"


ALNUM, BASE64 = string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/"


def junk(rng, alphabet, n, word, sep):
    text = "".join(rng.choice(alphabet) for _ in range(n))
    return sep.join(text[i : i + word] for i in range(0, n, word))[:n].encode()


@pytest.mark.parametrize(("alphabet", "word", "sep", "least"), [(ALNUM, 5, " ", 300), (ALNUM, 8, " ", 300), (ALNUM, 10, "\n", 300), (BASE64, 10, " ", 120), (BASE64, 76, "\n", 120)])
def test_encoded_junk_of_each_band(alphabet, word, sep, least):
    rng, compressor = random.Random(5), zstandard.ZstdCompressor(level=LEVEL)
    ends = [b.bytes - 1 for b in BANDS[2:]] + [100_000]
    for band, end in zip(BANDS[1:], ends, strict=True):
        for n in (band.bytes, (band.bytes + end) // 2, end) if band.bytes >= least else ():
            text = junk(rng, alphabet, n, word, sep)
            assert verdict(n, *ratios(text, compressor)) == "incompressible", (n, ratios(text, compressor))
    assert all(len(compressor.compress(junk(rng, alphabet, CHUNK, word, sep))) > CHUNK_HIGH * CHUNK for _ in range(50))


def test_prose_of_each_band_is_accepted():
    rng, compressor = random.Random(5), zstandard.ZstdCompressor(level=LEVEL)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    for band in BANDS[1:]:
        text = " ".join(rng.choices(words, range(3000, 0, -1), k=band.bytes))[: band.bytes + 10].encode()
        assert verdict(len(text), *ratios(text, compressor)) is None, (band, ratios(text, compressor))


def test_every_byte_is_in_a_chunk():
    rng, compressor = random.Random(5), zstandard.ZstdCompressor(level=LEVEL)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(3000)).encode()
    encoded, repeated = junk(rng, BASE64, CHUNK, 10, " "), b"again " * CHUNK
    for whole in (1, 2, 3):
        for tail in (CHUNK // 2 + 600, CHUNK - 1):
            n = whole * CHUNK
            assert ratios(prose[:n] + encoded[:tail], compressor)[1:] == (0.0, 1 / (whole + 1))
    assert ratios(prose[:CHUNK] + repeated[: CHUNK - 1], compressor)[1] == 0.5
    assert ratios(encoded, compressor)[1:] == (0.0, 1.0) and ratios(encoded[:-1], compressor)[1:] == (0.0, 0.0)
