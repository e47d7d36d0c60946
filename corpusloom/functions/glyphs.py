"""Glyphs of right-to-left text: repairs of their order as Arrow-batched pandas UDFs; measures of boxes and defects as columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---- Fixed values: they must equal the reference's for equal results. ----
ALEFS = "اأإآ"
LAM = "ل"
DIGITS = "٠١٢٣٤٥٦٧٨٩"
ZERO_WIDTH = 0.01
LEFT_TO_RIGHT = re.compile(r"[A-Za-z0-9]")
MARKS = ".،؛:؟!"
STEP = 0.5
# ---- End of fixed values. ----

GLYPHS = "array<struct<c:string,x0:double,x1:double>>"


def shape(glyphs: list[dict]) -> str:
    """A class for each glyph: A zero-width alef, L lam, D Arabic digit, else a dot."""
    return "".join(
        "L" if g["c"] == LAM else "D" if g["c"] in DIGITS else "A" if g["c"] in ALEFS and g["x1"] - g["x0"] < ZERO_WIDTH else "." for g in glyphs
    )


def swap_lam_alef(glyphs: list[dict]) -> list[dict]:
    out = list(glyphs)
    for m in re.finditer("AL", shape(glyphs)):
        out[m.start() : m.end()] = out[m.start() : m.end()][::-1]
    return out


def drop_stray_alefs(glyphs: list[dict]) -> list[dict]:
    kinds = shape(glyphs)
    return [g for g, k, before in zip(glyphs, kinds, " " + kinds, strict=False) if k != "A" or before == "L"]


def order_digits(glyphs: list[dict]) -> list[dict]:
    out = list(glyphs)
    for m in re.finditer("D{2,}", shape(glyphs)):
        out[m.start() : m.end()] = sorted(out[m.start() : m.end()], key=lambda g: g["x0"])
    return out


def move_right(glyphs: list[dict], at: int) -> list[dict]:
    """Moves one glyph past the following ones that are drawn to its right, up to a left-to-right run."""
    mover, rest = glyphs[at], glyphs[at + 1 :]
    n = next((i for i, g in enumerate(rest) if LEFT_TO_RIGHT.match(g["c"]) or g["x0"] <= mover["x0"] + STEP), len(rest))
    return [*glyphs[:at], *rest[:n], mover, *rest[n:]]


def reorder(glyphs: list[dict]) -> list[dict]:
    """Spaces, then marks, each from the right; a mark neither follows a left-to-right run nor moves before a space."""
    for at in range(len(glyphs) - 1, -1, -1):
        if glyphs[at]["c"].isspace():
            glyphs = move_right(glyphs, at)
    for at in range(len(glyphs) - 2, -1, -1):
        if glyphs[at]["c"] in MARKS and not (at and LEFT_TO_RIGHT.match(glyphs[at - 1]["c"])) and not glyphs[at + 1]["c"].isspace():
            glyphs = move_right(glyphs, at)
    return glyphs


def repaired(glyphs: list[dict]) -> str:
    """Text of a piece after all repairs."""
    return "".join(g["c"] for g in reorder(drop_stray_alefs(order_digits(swap_lam_alef(list(glyphs))))))


@F.pandas_udf(StringType())
def repair_glyphs(pieces: pd.Series) -> pd.Series:
    return pieces.map(repaired, na_action="ignore")


def vertical_overlap(top_a: Column, bottom_a: Column, top_b: Column, bottom_b: Column) -> Column:
    """Share of the lower box's height in which two boxes overlap; 0 for a box without height."""
    return overlap_of_heights(top_a, bottom_a - top_a, top_b, bottom_b - top_b)


def overlap_of_heights(top_a: Column, height_a: Column, top_b: Column, height_b: Column) -> Column:
    """The same of boxes with known heights, which edges that were rounded would give inexactly."""
    lower = F.least(height_a, height_b)
    below_a, below_b = F.greatest(top_a - top_b, F.lit(0.0)), F.greatest(top_b - top_a, F.lit(0.0))
    return F.when(lower > 0, F.greatest(F.least(height_a - below_b, height_b - below_a), F.lit(0.0)) / lower).otherwise(0.0)


def broken_lam_alefs(glyphs: Column) -> Column:
    """Six characters before to seven after each zero-width alef that stands right before a lam; glyphs are those of one span."""
    places = F.when(F.size(glyphs) > 1, F.sequence(F.lit(1), F.size(glyphs) - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.element_at(glyphs, i)
    broken = F.filter(places, lambda i: at(i)["c"].isin(*ALEFS) & (at(i)["x1"] - at(i)["x0"] < ZERO_WIDTH) & (at(i + 1)["c"] == LAM))
    around = lambda i: F.slice(glyphs, F.greatest(i - 6, F.lit(1)), i + 8 - F.greatest(i - 6, F.lit(1)))
    return F.transform(broken, lambda i: F.array_join(F.transform(around(i), lambda g: g["c"]), ""))


def digit_runs(glyphs: Column) -> Column:
    """(descending_x, ascending_x, mixed): runs of two or more Arabic digits by the order of their places; equal places descend."""
    kind = "struct<run:array<double>,descending_x:int,ascending_x:int,mixed:int>"
    start = F.struct(F.array().cast("array<double>").alias("run"), *[F.lit(0).alias(n) for n in ("descending_x", "ascending_x", "mixed")]).cast(kind)

    def step(acc: Column, g: Column) -> Column:
        up, down = F.array_sort(acc["run"]), F.reverse(F.array_sort(acc["run"]))
        ends = F.size(acc["run"]) > 1
        falls, rises = ends & (acc["run"] == down), ends & (acc["run"] == up) & (acc["run"] != down)
        counted = F.struct(
            F.array().cast("array<double>").alias("run"), (acc["descending_x"] + falls.cast("int")).alias("descending_x"), (acc["ascending_x"] + rises.cast("int")).alias("ascending_x"),
            (acc["mixed"] + (ends & ~falls & ~rises).cast("int")).alias("mixed"),
        )
        grown = F.struct(F.array_append(acc["run"], g["x0"]).alias("run"), acc["descending_x"], acc["ascending_x"], acc["mixed"])
        return F.when(g["c"].isin(*DIGITS), grown.cast(kind)).otherwise(counted.cast(kind))

    end = F.array(F.struct(F.lit(" ").alias("c"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("x1")))
    return F.aggregate(F.concat(F.transform(glyphs, lambda g: F.struct(g["c"].alias("c"), g["x0"].alias("x0"), g["x1"].alias("x1"))), end), start, step, lambda acc: F.struct(acc["descending_x"], acc["ascending_x"], acc["mixed"]))


def highlighted_text(line: Column, fills: Column, blank: str = "\\s") -> Column:
    """A line's characters from the first to the last whose middle lies in a fill, without blanks around and full stops before; empty if none does.

    line: array of (c, x0, y0, x1, y1) in reading order; fills: array of (x0, y0, x1, y1), whose right and lower edges are outside;
    blank: pattern of one blank. Null for null.
    """
    def under(g: Column) -> Column:
        x, y = (g["x0"] + g["x1"]) / 2, (g["y0"] + g["y1"]) / 2
        return F.exists(fills, lambda f: (f["x0"] <= x) & (x < f["x1"]) & (f["y0"] <= y) & (y < f["y1"]))

    marks = F.transform(line, under)
    first = F.array_position(marks, F.lit(True)).cast("int")
    last = F.size(line) + 1 - F.array_position(F.reverse(marks), F.lit(True)).cast("int")
    text = F.array_join(F.transform(F.slice(line, F.greatest(first, F.lit(1)), F.greatest(last - first + 1, F.lit(0))), lambda g: g["c"]), "")
    shown = F.regexp_replace(F.regexp_replace(text, rf"^(?:{blank})+|(?:{blank})+\z", ""), r"^[. ]+", "")
    return F.when(line.isNotNull() & fills.isNotNull(), F.when(first > 0, shown).otherwise(F.lit("")))
