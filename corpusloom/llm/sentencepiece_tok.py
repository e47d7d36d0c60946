"""SentencePiece models on the tokenizers library.

The model's protobuf is read by a small wire-format parser; normaliser, metaspace marker, piece scores and byte
fallback are rebuilt as a tokenizers pipeline, unigram or BPE as the model says. Batches of whole texts are encoded by
several of the library's threads, and again by the sentencepiece library, which verifies parity of every text's ids.
"""

from __future__ import annotations

import contextlib
import itertools
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import added, slices, with_text
from corpusloom.llm.wordtable import give_back, resident

META = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words whose pieces are merged together.
WORDS = 16


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: varints as int, all else as bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"wire type {kind} is not supported")
            size = varint()
        yield key >> 3, data[i : i + size]
        i += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    treat_whitespace_as_suffix: bool = False


def parse(data: bytes) -> Model:
    """Field numbers are those of sentencepiece_model.proto: 1 pieces, 2 trainer, 3 normaliser."""
    m = Model()
    for number, value in wire(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in wire(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in wire(value):
                if n == 3:
                    m.kind = v
                elif n == 24:
                    m.treat_whitespace_as_suffix = bool(v)
                elif n == 35:
                    m.byte_fallback = bool(v)
                elif n == 40:
                    m.unk_id = v
        elif number == 3:
            for n, v in wire(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.add_dummy_prefix = bool(v)
                elif n == 4:
                    m.remove_extra_whitespaces = bool(v)
                elif n == 5:
                    m.escape_whitespaces = bool(v)
    if m.kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {m.kind} is not supported")
    return m


def separable(m: Model) -> bool:
    """No piece goes on past a word start: texts may be cut before each run of markers, and words be cached."""
    return not m.treat_whitespace_as_suffix and m.escape_whitespaces and not any(k in (NORMAL, USER_DEFINED) and re.search(f"[^{META}]{META}", p) for p, _, k in m.pieces)


def plain(m: Model) -> bool:
    """The normaliser only writes markers for spaces and one before the text, which is done as cheaply before the pipeline."""
    return m.add_dummy_prefix and m.escape_whitespaces and not m.charsmap and not m.remove_extra_whitespaces


def build(m: Model):
    """The tokenizers pipeline of a model; control pieces in a text are ordinary text, as in sentencepiece.

    A plain model's texts come with their markers written (see Codec), others are normalised here. A separable
    model's texts are worked on a word at a time, or WORDS where pieces are merged: a cut costs more than the library's
    store of words saves, and uncut long texts make long queues of merges.
    """
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
    if m.kind == UNIGRAM:
        # Only normal and user-defined pieces may be found in texts; others keep their place with a mark that no text has.
        listed = [(p if k in (NORMAL, UNKNOWN, USER_DEFINED, BYTE) else f"\x00{i}\x00", s) for i, (p, s, k) in enumerate(m.pieces)]
        core = models.Unigram(listed, m.unk_id, m.byte_fallback)
    else:
        # BPE pieces are merged in falling order of score; equal scores in order of id.
        rank = {p: (-s, i) for i, (p, s, k) in enumerate(m.pieces) if k in (NORMAL, USER_DEFINED)}
        merges = sorted(((rank[a + b], len(a), a, b) for p in rank for a, b in ((p[:j], p[j:]) for j in range(1, len(p))) if a in rank and b in rank), key=lambda x: x[:2])
        # The library's store of words holds little that comes again in WORDS words, at some 80 MB a worker.
        core = models.BPE(vocab, [(a, b) for _, _, a, b in merges], unk_token=m.pieces[m.unk_id][0], fuse_unk=True, byte_fallback=m.byte_fallback, cache_capacity=0)
    t = Tokenizer(core)
    steps = []
    if m.charsmap:
        steps.append(normalizers.Precompiled(m.charsmap))
    if m.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.add_dummy_prefix:
        steps.append(normalizers.Prepend(" ") if not m.escape_whitespaces else normalizers.Prepend(META))
    if m.escape_whitespaces:
        steps.append(normalizers.Replace(" ", META))
    if steps and not plain(m):
        t.normalizer = normalizers.Sequence(steps)
    if separable(m):
        most = WORDS if m.kind == BPE else 1
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"(?:{META}*+[^{META}]++){{1,{most}}}|{META}+"), "isolated")
    back = [decoders.Replace(META, " ")] if m.escape_whitespaces else []
    back += [decoders.ByteFallback()] if m.byte_fallback else []
    back.append(decoders.Fuse())
    if m.add_dummy_prefix:
        back.append(decoders.Strip(" ", 1, 0))
    t.decoder = decoders.Sequence(back)
    return t


class Codec:
    """One worker's encoder and decoder of a model, verified against the sentencepiece library."""

    def __init__(self, data: bytes, threads: int = 1):
        import sentencepiece

        self.model = m = parse(data)
        self.threads = threads
        self.tokenizer = build(m)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.is_byte = np.array([k == BYTE for _, _, k in m.pieces])
        self.spelled = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(META, " ").encode() for p, _, k in m.pieces]
        self.spellings = pa.array(self.spelled, pa.large_binary())
        self.plain = plain(m)
        #: A text may be cut at a single space: the dummy prefix stands for it.
        self.cuts = separable(m) and self.plain

    def encode(self, texts: list[str]) -> list[tuple[list[int], bool]]:
        """(ids, parity) of each text. Texts of over LONG_CHARS are encoded and compared in parts, where the model allows.

        Equal texts of a batch are encoded once.
        """
        parts = {t: self.parts(t) for t in dict.fromkeys(texts)}
        flat = [x for p in parts.values() for x in p]
        marked = [META + x.replace(" ", META) if x else x for x in flat] if self.plain else flat
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(marked, add_special_tokens=False)]
        same = map(list.__eq__, ids, self.reference.encode(flat, num_threads=self.threads))
        if len(flat) > len(parts):
            left = iter(zip(ids, same, strict=True))
            joined = [tuple(zip(*itertools.islice(left, len(p)), strict=True)) for p in parts.values()]
            ids, same = [list(itertools.chain.from_iterable(x)) for x, _ in joined], [all(x) for _, x in joined]
        out = dict(zip(parts, zip(ids, same, strict=True), strict=True))
        return [out[t] for t in texts]

    def parts(self, text: str) -> list[str]:
        """The text, or its parts between single spaces inside words' neighbours, each about LONG_CHARS long."""
        found, begin = [], 0
        while self.cuts and len(text) - begin > LONG_CHARS:
            cut = LONE_SPACE.search(text, begin + LONG_CHARS)
            if cut is None:
                break
            found.append(text[begin : cut.start() + 1])
            begin = cut.end()
        return [*found, text[begin:]]

    def returns(self, texts: list[str | None], found: list[list[int]], flat: np.ndarray, offsets: np.ndarray) -> list[bool]:
        """Whether the ids found of each text decode to it; flat holds all ids, offsets where each text's begin.

        Pieces and bytes are put together for all texts at once; those that differ then are decoded one by one.
        """
        said = self.spellings.take(pa.array(flat))
        ends = np.frombuffer(said.buffers()[1], np.int64, len(flat) + 1)[offsets].tolist() if len(flat) else [0] * len(offsets)
        data = memoryview(said.buffers()[2] or b"")
        spelt = self.model.escape_whitespaces and self.model.add_dummy_prefix
        out = []
        for i, x in enumerate(texts):
            same = spelt and x is not None and bytes(data[ends[i] : ends[i + 1]]).removeprefix(b" ") == x.encode()
            out.append(same or x is not None and self.decode(found[i]) == x)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces and bytes put together, less the dummy prefix; as the library's decoder does."""
        if self.model.escape_whitespaces and self.model.add_dummy_prefix:
            with contextlib.suppress(UnicodeDecodeError):
                return b"".join(map(self.spelled.__getitem__, ids)).decode().removeprefix(" ")
        return self.tokenizer.decode(ids, skip_special_tokens=False)


def codec_for(data: bytes, threads: int) -> Codec:
    def make() -> Codec:
        # read when the library first makes its threads, once in a worker
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        return Codec(data, threads)

    return resident((hash(data), threads), make)


FIELDS = (("token_ids", "array<int>"), ("n_tokens", "int"), ("n_byte_tokens", "int"), ("round_trip", "boolean"), ("parity", "boolean"))
#: Characters of texts that are worked on together, but for single longer texts.
BATCH_CHARS = 250_000
#: Characters from which a text may be cut, at a single space between two characters that are neither space nor marker.
LONG_CHARS = 1_000_000
LONE_SPACE = re.compile(f"[^ {META}] (?=[^ {META}])")
#: Threads that encode a task's batches, at least.
THREADS = 2


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= BATCH_CHARS or i == len(texts) - 1:
            yield begin, i + 1
            begin, size = i + 1, 0


def task_cores(spark: SparkSession) -> int:
    """The cores that Spark gives to a task: one, unless spark.task.cpus says otherwise."""
    return int(spark.sparkContext.getConf().get("spark.task.cpus", "1"))


def encode_texts(docs: DataFrame, model_file: str, *, text: str = "text", threads: int | None = None) -> DataFrame:
    """Adds token_ids, n_tokens, n_byte_tokens (of byte fallback), round_trip (the ids decode to the text) and parity.

    Whole texts are encoded, without special tokens. A null text has null results, an empty one no tokens.
    parity: the ids are those of the sentencepiece library. ``threads`` of the tokenizers library work on a batch,
    unless given as many as a task has cores, THREADS at least. The driver reads the model file. Rows are encoded one by
    one, so that repeated rows and null ids need no care; an empty table has an empty result. A text of over LONG_CHARS
    is encoded in parts cut at single spaces, which gives the same ids. Other columns stay; those named like the results
    are replaced.
    """
    with open(model_file, "rb") as f:
        data = f.read()
    threads = threads or max(THREADS, task_cores(docs.sparkSession))
    names = [n for n, _ in FIELDS]
    kept = [c for c in docs.columns if c not in names]
    schema = added(docs, kept, ", ".join(f"{n} {t}" for n, t in FIELDS))
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(shared.value, threads)
        for b in slices(batches):
            texts = b.column(text).to_pylist()
            for begin, end in _blocks(texts):
                part = texts[begin:end]
                null = np.array([x is None for x in part])
                found = codec.encode([x or "" for x in part])
                sizes = np.array([len(ids) for ids, _ in found])
                flat = np.fromiter(itertools.chain.from_iterable(ids for ids, _ in found), np.int32, int(sizes.sum()))
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                n_bytes = np.diff(np.concatenate([[0], np.cumsum(codec.is_byte[flat])])[offsets])
                back = codec.returns(part, [ids for ids, _ in found], flat, offsets)
                arrays = [
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array(null)),
                    pa.array(sizes, pa.int32(), mask=null),
                    pa.array(n_bytes, pa.int32(), mask=null),
                    pa.array(np.array(back, bool), mask=null),
                    pa.array(np.array([same for _, same in found], bool), mask=null),
                ]
                here = b.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*[here.column(c) for c in kept], *arrays], [*kept, *names])
        give_back()  # encodings are made and dropped by several threads, each with memory of its own

    return with_text(docs, kept, text).mapInArrow(run, schema)


def decode_ids(rows: DataFrame, model_file: str, *, ids: str = "token_ids", name: str = "decoded") -> DataFrame:
    """Adds the text of each row's ids; null ids have a null text. Other columns stay."""
    with open(model_file, "rb") as f:
        data = f.read()
    kept = [c for c in rows.columns if c != name]
    shared = rows.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(shared.value, 1)
        for b in batches:
            texts = [None if x is None else codec.decode(x) for x in b.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(texts, pa.string())], [*kept, name])

    return rows.select(*kept, F.col(ids).cast("array<int>").alias("__ids")).mapInArrow(run, added(rows, kept, f"`{name}` string"))
