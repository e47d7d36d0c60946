"""Language identification: script ranges narrow the candidates, then Viterbi over words labels spans.

A word's script leaves the languages that use it; its character n-grams give each of them a log-likelihood, taken
relative to the mean of the candidates and clipped. The path of languages over a text's words that has the
largest sum, less a penalty for each switch, gives spans of one language. A text's language is the one whose
spans have most letters. What is written without spaces between words is cut into pieces of a few characters, which
count as words.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.common import Sample, added, labelled_sample, slices, with_text
from corpusloom.llm.wordtable import SPACE, WordTable, code_points, grams, owners, sums, resident

UNDETERMINED = "und"
BUCKETS = 1 << 17
GRAMS = (2, 3, 4)
# First and last code points of blocks, by script.
SCRIPTS = (
    ("latin", ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F),)),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("gurmukhi", ((0xA00, 0xA7F),)),
    ("gujarati", ((0xA80, 0xAFF),)),
    ("oriya", ((0xB00, 0xB7F),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("telugu", ((0xC00, 0xC7F),)),
    ("kannada", ((0xC80, 0xCFF),)),
    ("malayalam", ((0xD00, 0xD7F),)),
    ("sinhala", ((0xD80, 0xDFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("lao", ((0xE80, 0xEFF),)),
    ("tibetan", ((0xF00, 0xFFF),)),
    ("myanmar", ((0x1000, 0x109F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("hangul", ((0x1100, 0x11FF), (0xAC00, 0xD7AF))),
    ("ethiopic", ((0x1200, 0x139F),)),
    ("khmer", ((0x1780, 0x17FF),)),
    ("mongolian", ((0x1800, 0x18AF),)),
    ("kana", ((0x3040, 0x30FF),)),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF))),
)
OTHER = len(SCRIPTS)
# Scripts without spaces between words, and bytes one of which begins each of their characters in UTF-8.
UNSPACED = ("thai", "lao", "tibetan", "myanmar", "khmer", "kana", "han")
UNSPACED_BYTES = re.compile(b"[\xe0\xe1\xe3-\xe9]")
_UNSPACED = "".join(f"{chr(a)}-{chr(b)}" for name, blocks in SCRIPTS if name in UNSPACED for a, b in blocks)
#: A word: of other scripts all up to a space, of these at most four characters.
UNIT = re.compile(f"[{_UNSPACED}]{{1,4}}|[^\\x20\\x09-\\x0D{_UNSPACED}]+")


class Characters:
    """Which code points are letters, and their scripts; the first 65,536 are looked up in an array."""

    def __init__(self):
        self.alpha = np.array([chr(i).isalpha() for i in range(0x10000)])
        self.script = np.full(0x10000, OTHER, np.int8)
        for k, (_, blocks) in enumerate(SCRIPTS):
            for first, last in blocks:
                self.script[first : last + 1] = k

    def letters(self, points: np.ndarray) -> np.ndarray:
        low = self.alpha[np.minimum(points, 0xFFFF)]
        for i in np.flatnonzero(points > 0xFFFF):
            low[i] = chr(points[i]).isalpha()
        return low

    def scripts(self, points: np.ndarray) -> np.ndarray:
        return np.where(points > 0xFFFF, OTHER, self.script[np.minimum(points, 0xFFFF)])


@cache
def characters() -> Characters:
    return Characters()


def units(text: bytes) -> list[bytes]:
    """A text's words."""
    if not UNSPACED_BYTES.search(text):
        return text.split()
    return [x.encode("utf-8", "replace") for x in UNIT.findall(text.decode("utf-8", "replace"))]


def places(text: bytes) -> list[tuple[int, int]]:
    """Where its words begin and end, in code points."""
    return [m.span() for m in UNIT.finditer(text.decode("utf-8", "replace"))]


def describe(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word) of the n-grams of the words' lower-cased letters, and letters by word and script."""
    points = code_points(words, lower=True)
    letter = characters().letters(points)
    points = points[letter | (points == SPACE)]
    word = owners(points)
    real = points != SPACE
    used = np.bincount(word[real] * (OTHER + 1) + characters().scripts(points[real]), minlength=len(words) * (OTHER + 1))
    return *grams(points, GRAMS, BUCKETS), used.reshape(len(words), OTHER + 1)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    logp: np.ndarray  # buckets x languages
    uses: np.ndarray  # scripts x languages: is it a candidate
    penalty: float = 10.0
    clip: float = 4.0
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def evidence(self, words: list[bytes]) -> np.ndarray:
        """Of each language, relative to the candidates' mean; then the number of letters."""
        bucket, of, used = describe(words)
        z = sums(self.logp[bucket], of, len(words))
        may = self.uses[used.argmax(1)]  # by the script of most letters
        some = may.any(1, keepdims=True) & (used.sum(1, keepdims=True) > 0)
        z -= (z * may).sum(1, keepdims=True) / np.maximum(may.sum(1, keepdims=True), 1)
        z = np.where(may, np.clip(z, -self.clip, self.clip), -self.clip)
        return np.append(np.where(some, z, 0), used.sum(1, keepdims=True), 1)

    def table(self) -> WordTable:
        return resident(self.key, lambda: WordTable(len(self.languages) + 1, self.evidence))

    def rows(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The evidence of each text's words."""
        table = self.table()
        for ids in table.ids(map(units, texts)):
            yield table.values[ids]

    def spans(self, rows: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray]:
        """(first word, end, language number) of each span, and letters by language."""
        n = len(self.languages)
        if not len(rows) or not n:
            return [], np.zeros(n)
        z, size = rows[:, :n], rows[:, n]
        best = int(z.sum(0).argmax())
        # One language throughout is best if no other gains over half a penalty on any stretch.
        run = np.cumsum(z - z[:, [best]], 0)
        low = np.minimum(np.minimum.accumulate(np.vstack([np.zeros(n), run[:-1]]), 0), 0)
        if ((run - low).max(0) <= self.penalty / 2).all():
            count = np.zeros(n)
            count[best] = size.sum()
            return [(0, len(rows), best)], count
        path = self.viterbi(z)
        cut = np.flatnonzero(np.diff(path)) + 1
        bounds = [0, *cut.tolist(), len(rows)]
        return [(a, b, int(path[a])) for a, b in zip(bounds, bounds[1:], strict=False)], np.bincount(path, size, n)

    def viterbi(self, z: np.ndarray) -> np.ndarray:
        """The best path; of equal ones, the first language in order at the end and before each switch."""
        total = [0.0] * z.shape[1]
        came: dict[int, list[int]] = {}  # where some language is better reached by a switch
        for i, row in enumerate(z.tolist()):
            reach = max(total) - self.penalty
            if min(total) < reach:
                top = total.index(max(total))
                came[i] = [j if t >= reach else top for j, t in enumerate(total)]
                total = [(t if t >= reach else reach) + s for t, s in zip(total, row)]
            else:
                total = [t + s for t, s in zip(total, row)]
        at = total.index(max(total))
        path = np.empty(len(z), np.int64)
        end = len(z)
        for i in sorted(came, reverse=True):
            if came[i][at] != at:
                path[i:end] = at
                at, end = came[i][at], i
        path[:end] = at
        return path

    def predict(self, texts: list[bytes]) -> Iterator[tuple[str, float, list[tuple[int, int, int]]]]:
        """Of each text the language with most letters and its share of letters, ``und`` and 0 without a letter; spans."""
        for rows in self.rows(texts):
            spans, count = self.spans(rows)
            total = count.sum()
            top = int(count.argmax()) if total else 0
            yield (self.languages[top], float(count[top] / total), spans) if total else (UNDETERMINED, 0.0, [])


def train(sample: Sample, *, smooth: float = 0.5, least_share: float = 0.02) -> LanguageModel:
    """N-gram frequencies of each language; a language uses a script with at least that share of its letters.

    Every distinct word of a text counts once. Without labelled texts there is no language, and all texts are ``und``.
    """
    languages = tuple(sorted(set(sample.labels)))
    at = {x: i for i, x in enumerate(languages)}
    counts = np.zeros((BUCKETS, len(languages)))
    scripts = np.zeros((OTHER + 1, len(languages)))
    for text, label in zip(sample.texts, sample.labels, strict=True):
        if words := list(set(units(text))):
            bucket, _, used = describe(words)
            np.add.at(counts, (bucket, at[label]), 1)
            scripts[:, at[label]] += used.sum(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        logp = np.log((counts + smooth) / (counts.sum(0) + smooth * BUCKETS))
        uses = np.nan_to_num(scripts / scripts.sum(0)) >= least_share
    return LanguageModel(languages, logp, uses)


def fit(docs: DataFrame, labelled: DataFrame, *, label: str = "lang", per_label: int = 400, max_rows: int = 40_000, seed: int = 0, key: str = "doc_id", text: str = "text") -> LanguageModel:
    """Learns from at most per_label texts of each language; where there are many languages, from max_rows in all, each having its part."""
    return train(labelled_sample(docs, labelled, label, per_label=per_label, max_rows=max_rows, key=key, text=text, seed=seed))


def label_texts(docs: DataFrame, model: LanguageModel, *, text: str = "text", name: str = "lang_pred", score: str = "score", spans: str | None = None) -> DataFrame:
    """Adds the language and score of each whole text, and with ``spans`` its (start, end, lang) spans, in code points.

    Null texts and those without a letter are ``und`` with score 0 and without spans; texts of any length are read whole.
    The result depends on the text alone, so repeated rows and null ids need no care; of equal languages the first in
    order counts. An empty table stays empty. Other columns stay; those named like the results are replaced.
    """
    kept = [c for c in docs.columns if c not in (name, score, spans)]
    schema = added(docs, kept, f"`{name}` string, `{score}` double" + (f", `{spans}` array<struct<start:int,end:int,lang:string>>" if spans else ""))

    def placed(text: bytes, found: list[tuple[int, int, int]]) -> list[dict]:
        at = places(text) if found else []
        return [{"start": at[i][0], "end": at[e - 1][1], "lang": model.languages[k]} for i, e, k in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [t or b"" for t in b.column(text).cast(pa.binary()).to_pylist()]
            found = list(model.predict(texts))
            columns = [*[b.column(c) for c in kept], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            if spans:
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                columns.append(pa.array([placed(t, x[2]) for t, x in zip(texts, found, strict=True)], kind))
            yield pa.RecordBatch.from_arrays(columns, [*kept, name, score, *([spans] if spans else [])])

    return with_text(docs, kept, text).mapInArrow(run, schema)
