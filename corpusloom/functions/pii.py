"""Personal data in texts: one pattern finds all kinds in one pass, in the JVM; pieces of a stream use the same pattern.

The pattern is an alternation, so the leftmost match wins and no two overlap; where an address and a phone number
begin together the address, which is then longer, comes first. It is written in what Java's and Python's ``regex``
have in common. Its digits are ASCII, Arabic or Persian ones, so it is matched on the text as it is.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import ARABIC_DIGITS, ASCII_DIGITS, PERSIAN_DIGITS, ascii_digits

# ---- Fixed values: kinds, and the words and codes that they are made of. ----
KINDS = ("national_id", "phone", "email", "name")
HONORIFICS = ("سيد", "سيدة", "أستاذ", "أستاذة", "دكتور", "دكتورة", "مواطن", "مواطنة", "مدعو", "مدعوة", "مهندس", "مهندسة")
BIRTHPLACES = "0[1-4]|1[1-9]|2[1-9]|3[1-5]|88"
ARABIC_LETTER = "[\\u0621-\\u064a]"
MOBILE = "(?:(?:\\+|00)20[\\s-]?)?0?1[0125](?:[\\s-]?[0-9]){8}"
# ---- End of fixed values. ----

_MONTH_DAY = "(?:0[13578]|1[02])(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)(?:0[1-9]|[12][0-9]|30)|02(?:0[1-9]|1[0-9]|2[0-8])"
# 29 February: of 19xx but 1900 every fourth year, of 20xx also 2000
_LEAP_DAY = "(?:2(?:0[48]|[13579][26]|[2468][048])|3(?:[13579][26]|[02468][048]))0229"
#: Century, birth date, place of birth, five more digits.
NATIONAL_ID = f"(?:[23][0-9]{{2}}(?:{_MONTH_DAY})|{_LEAP_DAY})(?:{BIRTHPLACES})[0-9]{{5}}"


def _any_digits(pattern: str) -> str:
    """The pattern with each ASCII digit, alone or in a class, standing for the Arabic and the Persian one too; counts in braces stay."""
    def wide(m: re.Match) -> str:
        inside = m[0].strip("[]")
        if m[0][0] == "{" or not re.search("[0-9]", inside):
            return m[0]
        return f"[{inside}{''.join(inside.translate(str.maketrans(ASCII_DIGITS, d)) for d in (ARABIC_DIGITS, PERSIAN_DIGITS))}]"

    return re.sub(r"\{[^}]*\}|\[[^\]]*\]|[0-9]", wide, pattern)


_LOCAL, _HOST = "[\\p{L}\\p{N}_.+-]", "[\\p{L}\\p{N}_-]"
_EMAIL = f"{_LOCAL}++@{_HOST}+(?:\\.{_HOST}+)+"
#: An honorific with its article and prefixes, and the blanks after it; what follows is a name.
LEAD = f"(?<!{ARABIC_LETTER})(?:[وف]?[بك]?ال|[وف]?لل)(?:{'|'.join(HONORIFICS)})\\s+"
_NAME = f"(?!{_EMAIL})(?!ال){ARABIC_LETTER}+(?:\\s+{ARABIC_LETTER}+){{0,2}}"
_NUMBERS = {KINDS[0]: _any_digits(NATIONAL_ID), KINDS[1]: _any_digits(MOBILE)}
_DIGIT = _any_digits("[0-9]")


def pattern_of(kinds: Sequence[str]) -> str:
    """The pattern of some kinds; numbers and names look at their first character before anything else, which few places pass."""
    if not kinds or set(kinds) - set(KINDS):
        raise ValueError(f"kinds must be some of {KINDS}: {kinds}")
    numbers = "|".join(p for k, p in _NUMBERS.items() if k in kinds)
    parts = [f"(?:\\G|(?<!{_LOCAL})){_EMAIL}" if KINDS[2] in kinds else "", numbers and f"(?=[+]|{_DIGIT})(?<!{_DIGIT})(?:{numbers})(?!{_DIGIT})", f"(?=[وفبكال]){LEAD}{_NAME}" if KINDS[3] in kinds else ""]
    return "|".join(filter(None, parts))


PATTERN = pattern_of(KINDS)


def _kind(match: Column) -> Column:
    return (
        F.when(match.contains("@"), KINDS[2]).when(ascii_digits(match).rlike("^[23][0-9]{13}$"), KINDS[0]).when(match.rlike(f"^(?:[+]|{_DIGIT})"), KINDS[1]).otherwise(KINDS[3])
    )


def _lead(match: Column) -> Column:
    """The honorific before a name, which is not part of it."""
    return F.regexp_extract(match, "^" + LEAD, 0)


def _parts(text: Column, kinds: Sequence[str]) -> Column:
    """Array of (gap, match): what lies between matches, and these; the last match is null."""
    pattern = pattern_of(kinds)
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))


def find_pii(text: Column, kinds: Sequence[str] = KINDS) -> Column:
    """Array of (kind, start, end) in order, in code points; a name without its honorific. Null for null.

    The text's parts between matches give the places, so nothing is searched for twice.
    """
    kind = "struct<at:int,spans:array<struct<kind:string,start:int,end:int>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,start:int,end:int>>").alias("spans")).cast(kind)

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["gap"])
        end = begin + F.length(p["match"])
        what = _kind(p["match"])
        lead = F.when(what == KINDS[3], F.length(_lead(p["match"]))).otherwise(0)
        span = F.struct(what.alias("kind"), (begin + lead).alias("start"), end.alias("end"))
        return F.when(p["match"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.array_append(acc["spans"], span).alias("spans")).cast(kind))

    return F.when(text.isNotNull(), F.aggregate(_parts(text, kinds), start, step, lambda acc: acc["spans"]))


def redact(text: Column, kinds: Sequence[str] = KINDS) -> Column:
    """The text with every finding replaced by its kind in brackets: parts put together once, whatever their number."""

    def shown(p: Column) -> Column:
        what = _kind(p["match"])
        lead = F.when(what == KINDS[3], _lead(p["match"])).otherwise("")
        return F.when(p["match"].isNull(), p["gap"]).otherwise(F.concat(p["gap"], lead, F.lit("["), what, F.lit("]")))

    return F.when(text.rlike(pattern_of(kinds)), F.array_join(F.transform(_parts(text, kinds), shown), "")).otherwise(text)


@cache
def _compiled(kinds: tuple[str, ...]):
    import regex

    return regex.compile(pattern_of(kinds)), regex.compile(LEAD), str.maketrans(ARABIC_DIGITS + PERSIAN_DIGITS, ASCII_DIGITS * 2)


class Pieces:
    """Redacts a text that comes in pieces: what is shown joins to the redacted whole.

    Only what may still be part of a match is held back: the last word, which may become an address; from where the
    pattern, matched partially, reaches the end; and a match until a blank and another character follow, which tell that
    it goes on no further. One character before it is kept for what the pattern looks back at.
    """

    def __init__(self, before: str = "", held: str = "", kinds: Sequence[str] = KINDS):
        self.before, self.held, self.kinds = before, held, tuple(kinds)

    def take(self, piece: str, last: bool = False) -> str:
        pattern, lead, ascii_of = _compiled(self.kinds)
        text = self.before + self.held + piece
        plain, at, out = text.translate(ascii_of), len(self.before), []
        open_from = len(text)
        while not last and open_from > at and not text[open_from - 1].isspace():
            open_from -= 1
        for m in pattern.finditer(plain, at, partial=not last):
            after = plain[m.end() :]
            if not last and (m.partial or not after.strip() or not any(map(str.isspace, after))):
                open_from = min(open_from, m.start())
                break
            named = lead.match(plain, m.start())
            begin = named.end() if named and named.end() < m.end() else m.start()
            kind = KINDS[2] if "@" in m[0] else KINDS[3] if named else KINDS[0] if len(m[0]) == 14 and m[0][0] in "23" else KINDS[1]
            out += [text[at:begin], f"[{kind}]"]
            at = m.end()
        out.append(text[at:open_from])
        at = max(at, open_from)
        self.before, self.held = text[max(at - 1, 0) : at], text[at:]
        return "".join(out)
