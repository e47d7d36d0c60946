"""License scans: Aho-Corasick over words for notices and identifier tags, shunting-yard over licence expressions.

A text is reduced to its words, lower-cased and set apart by single spaces; one automaton finds all notice phrases in it, at
word boundaries and overlapping ones too, and the words of the identifier tag. Only texts that hold the tag's words are
read a second time, as they stand, by an automaton of the tag's spellings; the expression after each tag is parsed by the
shunting-yard algorithm and evaluated at once: ``or`` leaves the choice (the freer side's obligation), ``and`` binds by both
(the stricter side's), ``with`` a known exception makes a copyleft licence one step freer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.common import added, slices, with_text

#: What a licence asks for, in order: little more than a notice, changes shared file by file, whole works shared, no free use.
PERMISSIVE, WEAK, STRONG, RESTRICTED = 0, 1, 2, 3


@dataclass(frozen=True)
class Notice:
    """A phrase of words and the licence that it names; weight: how far it shows by itself that the text is licensed."""

    phrase: str
    label: str
    weight: float = 0.7
    base: bool = False


#: A licence's label and its obligation.
LICENCES = {
    "0bsd": PERMISSIVE, "agpl": STRONG, "apache": PERMISSIVE, "artistic": PERMISSIVE, "boost": PERMISSIVE, "bsd": PERMISSIVE, "cc-by": PERMISSIVE, "cc-by-nc": RESTRICTED,
    "cc-by-nc-nd": RESTRICTED, "cc-by-nc-sa": RESTRICTED, "cc-by-nd": RESTRICTED, "cc-by-sa": STRONG, "cc0": PERMISSIVE, "cddl": WEAK, "epl": WEAK, "eupl": STRONG, "gpl": STRONG, "isc": PERMISSIVE,
    "lgpl": WEAK, "mit": PERMISSIVE, "mpl": WEAK, "proprietary": RESTRICTED, "public-domain": PERMISSIVE, "sspl": RESTRICTED, "unlicense": PERMISSIVE, "zlib": PERMISSIVE,
}
NOTICES = (
    Notice("mit license", "mit", base=True),
    Notice("apache license", "apache", base=True),
    Notice("general public license", "gpl", base=True),
    Notice("lesser general public license", "lgpl"),
    Notice("library general public license", "lgpl"),
    Notice("affero general public license", "agpl"),
    Notice("server side public license", "sspl"),
    Notice("mozilla public license", "mpl"),
    Notice("eclipse public license", "epl"),
    Notice("european union public licence", "eupl"),
    Notice("common development and distribution license", "cddl"),
    Notice("boost software license", "boost"),
    Notice("artistic license", "artistic"),
    Notice("bsd license", "bsd"),
    Notice("isc license", "isc"),
    Notice("zlib license", "zlib"),
    Notice("this is free and unencumbered software released into the public domain", "unlicense"),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    Notice("permission to use copy modify and or distribute this software for any purpose", "isc"),
    Notice("redistribution and use in source and binary forms", "bsd"),
    *[
        Notice(f"{start} {words}", label)
        for label, words in (("cc-by", "by"), ("cc-by-sa", "by sa"), ("cc-by-nd", "by nd"), ("cc-by-nc", "by nc"), ("cc-by-nc-sa", "by nc sa"), ("cc-by-nc-nd", "by nc nd"))
        for start in ("cc", "creative commons")
    ],
    Notice("creative commons attribution", "cc-by"),
    Notice("creative commons attribution sharealike", "cc-by-sa"),
    Notice("creative commons attribution share alike", "cc-by-sa"),
    Notice("creative commons attribution noderivatives", "cc-by-nd"),
    Notice("creative commons attribution noncommercial", "cc-by-nc"),
    Notice("creative commons attribution noncommercial sharealike", "cc-by-nc-sa"),
    Notice("creative commons attribution noncommercial noderivatives", "cc-by-nc-nd"),
    Notice("creative commons zero", "cc0"),
    Notice("cc0 1 0", "cc0"),
    Notice("dedicated to the public domain", "public-domain", 0.5),
    Notice("all rights reserved", "proprietary", 0.3),
)
TAG_WORDS, TAG_SPELLINGS = "spdx license identifier", ("spdx-license-identifier:", "spdx-license-identifier :")
#: Starts of identifiers, lower-cased, by label where they are not the label itself; the longest that fits counts.
IDENTIFIERS = {"bsl-1": "boost", "cc-zero": "cc0", "gnu-gpl": "gpl", "public-domain": "public-domain", "the-unlicense": "unlicense"} | {x: x for x in LICENCES}
#: Exceptions that free what links to the work; any other name after WITH leaves the obligation as it is.
EXCEPTIONS = ("autoconf-exception", "bison-exception", "classpath-exception", "font-exception", "gcc-exception", "linux-syscall-note", "llvm-exception", "openssl-exception")
TAG_WEIGHT, BROKEN_TAG_WEIGHT = 0.95, 0.3

TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:_-]*)")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
SEPARATED = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))

FINDING = "struct<start:long,words:long,phrase:string,label:string>"
EXPRESSION = "struct<start:long,text:string,valid:boolean,obligation:int,labels:array<string>>"
FIELDS = (
    ("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double"),
    ("obligation", "int"), ("findings", f"array<{FINDING}>"), ("expressions", f"array<{EXPRESSION}>"),
)


def label_of(identifier: str) -> str | None:
    """The label of a licence identifier, or null for an unknown one: the longest known start that ends at a mark or the end."""
    name = identifier.lower().rstrip("+")
    cuts = [i for i, c in enumerate(name) if c in "-._"] + [len(name)]
    return next((IDENTIFIERS[name[:i]] for i in reversed(cuts) if name[:i] in IDENTIFIERS), None)


@dataclass(frozen=True)
class Value:
    """What an expression comes to: its obligation (null if a licence in it is unknown) and all its known labels."""

    obligation: int | None
    labels: frozenset[str] = field(default_factory=frozenset)
    name: str | None = None  # of a single identifier


def operand(name: str) -> Value:
    label = label_of(name)
    return Value(None if label is None else LICENCES[label], frozenset() if label is None else frozenset((label,)), name.lower())


def apply(op: str, a: Value, b: Value) -> Value | None:
    """One operator; null where ``with`` does not stand between two names."""
    if op == "with":
        if a.name is None or b.name is None:
            return None
        freed = a.obligation in (WEAK, STRONG) and b.name.startswith(EXCEPTIONS)
        return Value(a.obligation - 1 if freed else a.obligation, a.labels)
    known = [x.obligation for x in (a, b) if x.obligation is not None]
    if op == "or":  # an unknown side need not be chosen
        return Value(min(known, default=None), a.labels | b.labels)
    return Value(max(known) if len(known) == 2 else None, a.labels | b.labels)


def parse(text: str, at: int = 0) -> tuple[int, Value | None]:
    """Where the expression that begins at a place ends, and its value; null for one that is broken.

    Shunting-yard with a stack of operators and one of values. The expression ends at the end of its line or at the first
    token that cannot follow; what is before must be complete.
    """
    ops: list[str] = []
    values: list[Value] = []
    wants, end, broken = True, at, False  # wants: an operand must come

    def reduce() -> bool:
        b, a = values.pop(), values.pop()
        made = apply(ops.pop(), a, b)
        values.append(made or a)
        return made is not None

    while m := TOKEN.match(text, end):
        raw = m.group(1)
        token = raw.lower()
        if token == "(":
            if not wants:
                break
            ops.append(token)
        elif token == ")":
            if wants or "(" not in ops:
                break
            while ops[-1] != "(":
                broken |= not reduce()
            ops.pop()
            values[-1] = Value(values[-1].obligation, values[-1].labels)
        elif token in PRECEDENCE:
            if wants:
                break
            while ops and ops[-1] != "(" and PRECEDENCE[ops[-1]] >= PRECEDENCE[token]:
                broken |= not reduce()
            ops.append(token)
            wants = True
        else:
            if not wants:
                break
            values.append(operand(raw.rstrip(".:")))
            wants = False
            end = m.end() - (len(raw) - len(raw.rstrip(".:")))
            if raw[-1] in ".:":
                break  # a sentence's end
            continue
        end = m.end()
    if wants or "(" in ops:
        return end, None
    while ops:
        broken |= not reduce()
    return end, None if broken else values[0]


class Scanner:
    """The automata, built once a task."""

    def __init__(self, notices: tuple[Notice, ...] = NOTICES):
        self.words = ahocorasick.Automaton()
        merged: dict[str, list[Notice]] = {}
        for n in notices:
            merged.setdefault(n.phrase, []).append(n)
        for phrase, several in merged.items():
            self.words.add_word(self._padded(phrase), (phrase, tuple(several)))
        if TAG_WORDS not in merged:
            self.words.add_word(self._padded(TAG_WORDS), (TAG_WORDS, ()))
        self.words.make_automaton()
        self.tags = ahocorasick.Automaton()
        for x in TAG_SPELLINGS:
            self.tags.add_word(x, len(x))
        self.tags.make_automaton()

    @staticmethod
    def _padded(phrase: str) -> str:
        return f" {phrase} ".encode().decode("latin-1")  # texts are searched byte by byte

    def scan(self, text: bytes) -> tuple:
        """The columns of FIELDS for a whole text."""
        words = text.translate(SEPARATED).split()
        line = f" {b' '.join(words).decode('latin-1')} "
        hits, at, seen, tagged = [], 0, 0, False
        for end, (phrase, several) in self.words.iter(line):
            n = phrase.count(" ") + 1
            # the spaces up to a hit's end, its own last one not counted, are the words up to its end
            seen += line.count(" ", at, end)
            at = end
            tagged |= phrase == TAG_WORDS
            hits += [(seen - n, n, x) for x in several]
        base = [h for h in hits if h[2].base]
        # a notice within a longer one says nothing of its own; base ones always stay
        widest = sorted({(s, -n) for s, n, _ in hits})
        outer, high = set(), -1
        for s, n in widest:
            if s - n > high:
                outer.add((s, -n))
                high = s - n
        found = sorted((h for h in hits if h[2].base or (h[0], h[1]) in outer), key=lambda h: (h[0], h[1], h[2].label))
        expressions = list(self.expressions(text)) if tagged else []
        weights = {h[2].label: h[2].weight for h in sorted(found, key=lambda h: h[2].weight)}
        tag_labels = {x for e in expressions for x in e[4]}
        labels, base_labels = sorted(weights.keys() | tag_labels), sorted({h[2].label for h in base})
        doubt = 1.0
        for label in sorted(weights):
            doubt *= 1 - weights[label]
        for valid in sorted({e[2] for e in expressions}):
            doubt *= 1 - (TAG_WEIGHT if valid else BROKEN_TAG_WEIGHT)
        # notices and tags hold together; an unknown licence leaves what the others ask for
        asked = [LICENCES[x] for x in weights if x in LICENCES] + [e[3] for e in expressions if e[3] is not None]
        starts = [h[0] for h in base]
        return (
            len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(base_labels), ",".join(labels), 1 - doubt, max(asked, default=None),
            [(s, n, x.phrase, x.label) for s, n, x in found], expressions,
        )

    def expressions(self, text: bytes) -> Iterator[tuple]:
        """Start (in code points), text, validity, obligation and labels of the expression after each tag."""
        raw = text.decode("utf-8", "replace")
        for end, _ in self.tags.iter(raw.translate(LOWER)):
            stop, value = parse(raw, end + 1)
            said = raw[end + 1 : stop]
            start = end + 1 + len(said) - len(said.lstrip())
            yield start, said.strip(), value is not None, value and value.obligation, sorted(value.labels) if value else []


LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def scan_licenses(docs: DataFrame, *, text: str = "text", notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """Adds the columns of FIELDS to each row.

    n_words: words of the whole text; n_base, first_word, last_word, base_labels: places of the base notices, all of them,
    their smallest and largest start (words from 0, null without any) and labels; labels: with those of all notices
    that are not part of a longer one and of the expressions' licences, sorted and joined by commas, empty for none;
    score: how sure it is that the text is licensed, by noisy-or over labels and tags; obligation: what all of them
    together ask for (0 a notice, 1 and 2 shared changes, 3 no free use; null for none); findings: notices by place, of
    word and number of words; expressions: what follows each identifier tag, as far as it can be parsed, and its value.

    A null text counts as an empty one: no words, empty labels, score 0. Texts of any length are read whole, rows one by
    one, so repeated rows and null ids need no care; an empty table stays empty. Other columns stay; those named like
    the results are replaced.
    """
    names = [n for n, _ in FIELDS]
    kept = [c for c in docs.columns if c not in names]
    schema = added(docs, kept, ", ".join(f"{n} {t}" for n, t in FIELDS))
    finding = pa.struct([("start", pa.int64()), ("words", pa.int64()), ("phrase", pa.string()), ("label", pa.string())])
    expression = pa.struct([("start", pa.int64()), ("text", pa.string()), ("valid", pa.bool_()), ("obligation", pa.int32()), ("labels", pa.list_(pa.string()))])
    structs = {"findings": finding, "expressions": expression}
    plain = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    kinds = [pa.list_(structs[n]) if n in structs else plain[t] for n, t in FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for b in slices(batches):
            rows = [scanner.scan(x or b"") for x in b.column(text).cast(pa.binary()).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in FIELDS]
            for n, s in structs.items():
                columns[names.index(n)] = [[dict(zip(s.names, x, strict=True)) for x in several] for several in columns[names.index(n)]]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *arrays], [*kept, *names])

    return with_text(docs, kept, text).mapInArrow(run, schema)
