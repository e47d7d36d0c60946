"""Quality rules by compression bands.

zstandard ratios (compressed / raw UTF-8 bytes) of the whole text and of fixed chunks must lie within limits that
depend on length: below the band a text is repetitive, above it incompressible. Short texts have no upper limit
that means anything (frame overhead) and a lower one that only plain repetition reaches. Plain counts of words,
symbols, repeated lines and repeated word windows come with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import added, slices, with_text

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
LEVEL = 3


@dataclass(frozen=True)
class Band:
    """Limits for texts of at least this many bytes, up to the next band."""

    bytes: int
    low: float
    high: float


#: Upper limits lie between prose and encoded junk as measured at level 3, prose being that of 40,000 documents and junk
#: random a-z0-9 in words of 5 to 10, at the upper end of a band. From 700 bytes on no prose reaches its limit (0.66 at
#: 700 bytes, 0.57 at 1.6 kB, 0.47 at 6.4 kB, junk 0.675, 0.64 and 0.63). From 300 to 700 bytes junk sets the limit, and
#: some prose full of addresses and secrets is above it. Below 300 such prose and a-z0-9 overlap: prose sets the limit,
#: which keeps out base64 but not a-z0-9. Lower limits are under half of prose, where a repeated phrase is.
BANDS = (
    Band(0, 0.0, float("inf")), Band(120, 0.30, 1.0), Band(150, 0.30, 0.945), Band(200, 0.30, 0.87), Band(250, 0.30, 0.80),
    Band(300, 0.30, 0.74), Band(350, 0.30, 0.725), Band(400, 0.25, 0.713), Band(450, 0.25, 0.704), Band(500, 0.25, 0.688), Band(600, 0.25, 0.677),
    Band(700, 0.25, 0.67), Band(800, 0.25, 0.66), Band(1000, 0.25, 0.65), Band(1200, 0.25, 0.64), Band(1600, 0.18, 0.62), Band(6400, 0.13, 0.61), Band(25_600, 0.10, 0.60),
)
CHUNK = 2048
#: Of a text's chunks, at most these shares may be below or above the chunk limits. Chunks of prose are up to 0.56,
#: of random a-z0-9 0.645 and more, of base64 0.76.
CHUNK_LOW, CHUNK_HIGH, CHUNK_LOW_SHARE, CHUNK_HIGH_SHARE = 0.18, 0.62, 0.5, 0.25

FIELDS = (("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("ratio", "double"), ("low_chunk_share", "double"), ("high_chunk_share", "double"), ("reason", "string"))


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of 8 words that are found twice or more, the first time included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    code = np.zeros(n, np.uint64)
    for i in range(WINDOW):  # a polynomial over 64-bit hashes of words
        code = code * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[WINDOW : WINDOW + n] -= twice
    return int((np.cumsum(edge) > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.split()  # exactly runs outside space and \t..\r
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return (
        len(words),
        len(b"".join(words).decode("utf-8", "replace")),
        sum(map(text.count, (bytes([c]) for c in SYMBOLS))),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


def ratios(text: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float | None, float, float]:
    """Ratio of the whole text (null if empty) and the shares of its chunks below and above the chunk limits.

    The last chunk ends where the text does and overlaps the one before it; a text of less than a chunk has none.
    """
    if not text:
        return None, 0.0, 0.0
    whole = len(compressor.compress(text)) / len(text)
    if len(text) < CHUNK:
        return whole, 0.0, 0.0
    starts = [*range(0, len(text) - CHUNK, CHUNK), len(text) - CHUNK]
    chunks = [len(compressor.compress(text[i : i + CHUNK])) / CHUNK for i in starts]
    n = len(chunks)
    return whole, sum(r < CHUNK_LOW for r in chunks) / n, sum(r > CHUNK_HIGH for r in chunks) / n


def verdict(n_bytes: int, ratio: float | None, low_share: float, high_share: float, bands: tuple[Band, ...] = BANDS) -> str | None:
    """Why a text is rejected, or null."""
    if ratio is None:
        return None
    band = next(b for b in reversed(bands) if n_bytes >= b.bytes)
    if ratio < band.low:
        return "repetitive"
    if ratio > band.high:
        return "incompressible"
    if low_share > CHUNK_LOW_SHARE:
        return "repetitive chunks"
    if high_share > CHUNK_HIGH_SHARE:
        return "incompressible chunks"
    return None


def apply_rules(docs: DataFrame, *, text: str = "text", bands: tuple[Band, ...] = BANDS) -> DataFrame:
    """Adds the counts, ratio, chunk shares, reason (null: the bands accept), base_failed and kept to each row.

    base_failed: fewer than 20 words, or over 30 % of words in repeated windows. kept: neither base_failed nor a
    reason. Null text counts as empty: all counts 0, ratio null, base_failed. Texts of any length are judged whole. Rows
    are judged one by one, so repeated rows and null ids need no care; an empty table stays empty. Other columns stay;
    those named like the results are replaced.
    """
    names = [n for n, _ in FIELDS]
    kept = [c for c in docs.columns if c not in {*names, "base_failed", "kept"}]
    schema = added(docs, kept, ", ".join(f"{n} {t}" for n, t in FIELDS))
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for b in slices(batches):
            rows = []
            for x in b.column(text).cast(pa.binary()).to_pylist():
                x = x or b""
                r = ratios(x, compressor)
                rows.append((*base_counts(x), *r, verdict(len(x), *r, bands)))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in FIELDS]
            arrays = [pa.array(c, kinds[t]) for c, (_, t) in zip(columns, FIELDS, strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *arrays], [*kept, *names])

    judged = with_text(docs, kept, text).mapInArrow(run, schema)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & F.col("reason").isNull())
