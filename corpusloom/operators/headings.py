"""Headings of table cells in two languages: their units, the pairing of languages, titles that come on the next page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.corpus import AR_KEYWORDS, AR_NUMBERED, AR_ORDINAL, EN_KEYWORD, EN_NUMBERED, heading_rank, nested_ranks
from corpusloom.operators.ranges import running
from corpusloom.sources.records import stored

# ---- Fixed values: they must equal the reference's for equal results. ----
EN_KEYWORD_ONLY = r"(?i)^\s*(?:(?:PART|BOOK|CHAPTER|SECTION)\s+[IVXLC\d]+|[A-Z]+\s+PART)\s*\.*$"
AR_KEYWORD_ONLY = "^(" + "|".join(AR_KEYWORDS) + r")\s+\S+$"
# ---- End of fixed values. ----

UNIT = "struct<text:string,plain:boolean,waits:boolean,numbered:boolean>"
UNITS = f"array<{UNIT}>"


def _no_units() -> Column:
    return F.array().cast(UNITS)


def cell_lines(text: Column) -> Column:
    """The lines of a cell that are not blank, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def units(lines: Column, side: str) -> Column:
    """Headings of one language, in order: a line of a keyword alone takes the next line as its title, or waits for one.

    plain: neither a keyword nor a number opens it, so that it may be the rest of the title before.
    """
    if side not in ("en", "ar"):
        raise ValueError(f"no side {side}")
    keyword = EN_KEYWORD if side == "en" else "^(" + "|".join(AR_KEYWORDS) + ")(?![\\p{L}\\p{N}_])"
    alone = EN_KEYWORD_ONLY if side == "en" else AR_KEYWORD_ONLY

    def step(acc: Column, line: Column) -> Column:
        last = F.element_at(acc, -1)
        numbered = line.rlike(EN_NUMBERED) if side == "en" else line.rlike(AR_NUMBERED) | line.rlike(AR_ORDINAL)
        new = F.struct(line.alias("text"), (~line.rlike(keyword) & ~numbered).alias("plain"), line.rlike(alone).alias("waits"), numbered.alias("numbered")).cast(UNIT)
        titled = F.struct(F.concat(last["text"], F.lit(" "), line).alias("text"), last["plain"].alias("plain"), F.lit(False).alias("waits"), last["numbered"].alias("numbered")).cast(UNIT)
        return F.when((F.size(acc) > 0) & F.try_element_at(acc, F.lit(-1))["waits"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(titled))).otherwise(F.concat(acc, F.array(new)))

    return F.aggregate(lines, _no_units(), step)


def wraps_joined(listed: Column, target: Column) -> Column:
    """Plain units joined to the one before, the last first, while there are more than target."""
    kind = f"struct<out:{UNITS},rest:string,over:int,left:int>"
    size = F.size(listed)
    start = F.struct(_no_units().alias("out"), F.lit("").alias("rest"), (size - target).alias("over"), size.alias("left")).cast(kind)

    def step(acc: Column, u: Column) -> Column:
        text = F.concat(u["text"], acc["rest"])
        whole = F.struct(text.alias("text"), u["plain"].alias("plain"), u["waits"].alias("waits"), u["numbered"].alias("numbered")).cast(UNIT)
        joins = u["plain"] & (acc["over"] > 0) & (acc["left"] > 1)
        return F.when(joins, F.struct(acc["out"].alias("out"), F.concat(F.lit(" "), text).alias("rest"), (acc["over"] - 1).alias("over"), (acc["left"] - 1).alias("left")).cast(kind)).otherwise(
            F.struct(F.concat(F.array(whole), acc["out"]).alias("out"), F.lit("").alias("rest"), acc["over"].alias("over"), (acc["left"] - 1).alias("left")).cast(kind)
        )

    return F.aggregate(F.reverse(listed), start, step, lambda acc: acc["out"])


def aligned(en: Column, ar: Column) -> Column:
    """(pairs of (en, ar), aligned): headings of two languages by place.

    The side with more joins its wrapped titles until the counts agree; the other is filled with nulls, and aligned is false,
    if they still do not. A side without headings leaves the other as it is.
    """
    both = (F.size(en) > 0) & (F.size(ar) > 0)
    e = F.when(both & (F.size(en) > F.size(ar)), wraps_joined(en, F.size(ar))).otherwise(en)
    a = F.when(both & (F.size(ar) > F.size(en)), wraps_joined(ar, F.size(en))).otherwise(ar)
    return F.struct(F.arrays_zip(e.alias("en"), a.alias("ar")).alias("pairs"), (~both | (F.size(e) == F.size(a))).alias("aligned"))


def heading_rows(rows: DataFrame, *, pages: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(headings, anomalies) of classified rows (doc, page, row_index, kind, en_text, ar_text, ...).

    headings: (doc, pos, page, row_index, k, rank, en, ar), k counting within a cell, where each heading nests under the one
    before. A keyword alone at the end of a cell waits for a title: the first heading of the next row, if that is a
    heading row on another page, which is then no heading of its own. Else it is an anomaly, as are headings whose
    languages do not pair up and those that are numbered in one language only.

    A document is cut into ranges of so many pages; a range takes over what waits at the end of the one before it. Only heading
    cells are worked on, in three stored steps; page and row_index order a document's rows. No text but that of headings is moved.
    """
    place, span = ["page", "row_index"], F.floor(F.col("page") / pages)
    is_heading = F.col("kind") == "heading"
    rows = rows.select("doc", *place, "kind", *[F.when(is_heading, F.col(c)).alias(c) for c in ("en_text", "ar_text")])
    seq = running(rows, ["doc"], place, span, sums={"pos": F.lit(1)}, lags={"page_before": F.col("page")})
    seq = seq.withColumns({"pos": F.col("pos").cast("int"), "new_page": ~F.coalesce(F.col("page") == F.col("page_before"), F.lit(False))}).drop("page_before")
    cell = F.when(is_heading, aligned(units(cell_lines(F.col("en_text")), "en"), units(cell_lines(F.col("ar_text")), "ar")))
    seq = seq.withColumn("cell", cell).drop("en_text", "ar_text").withColumn("n", F.coalesce(F.size("cell.pairs"), F.lit(0)))
    last = F.try_element_at("cell.pairs", F.lit(-1))
    waits = F.coalesce(is_heading & (F.coalesce(last["en"]["waits"], F.lit(False)) | F.coalesce(last["ar"]["waits"], F.lit(False))), F.lit(False))
    takes = is_heading & F.col("new_page") & (F.col("n") > 0)
    seq = seq.withColumns({"waits": waits, "takes": F.coalesce(takes, F.lit(False))})
    # A row of one heading that waits, and may be a title itself, waits only if the row before does not: such rows in turn alternate.
    chained = F.col("waits") & F.col("takes") & (F.col("n") == 1)
    seq = stored(seq.withColumn("chained", chained), "heading-cells")
    seq = running(seq, ["doc"], place, span, sums={"run": (~F.col("chained")).cast("int")})
    within = Window.partitionBy("doc", "run").orderBy("pos")
    base = F.first(F.col("waits") & ~F.col("chained")).over(within.rowsBetween(Window.unboundedPreceding, 0))
    # before the first row that is not chained nothing waits, so a first chained row does
    odd = F.pmod(F.row_number().over(within) - F.when(F.col("run") == 0, 0).otherwise(1), F.lit(2)) == 1
    seq = seq.withColumn("pending", F.when(F.col("chained"), base != odd).otherwise(F.col("waits")))
    seq = stored(seq, "heading-runs")
    seq = running(seq, ["doc"], place, span, lags={"before": F.col("pending")}, leads={"after": F.col("takes"), "pairs_after": F.col("cell.pairs")})
    before, after = F.coalesce("before", F.lit(False)), F.col("after")
    seq = seq.withColumns({"titled": before & F.col("takes"), "untitled": F.col("pending") & ~F.coalesce(after, F.lit(True)), "title": F.when(F.col("pending") & F.coalesce(after, F.lit(False)), F.col("pairs_after")[0])})
    seq = stored(seq.drop("before", "after", "pairs_after"), "heading-titles")

    cells = seq.where("kind = 'heading'").select("doc", "pos", "page", "row_index", "pending", "title", F.posexplode("cell.pairs").alias("k", "pair"), "titled", "n")
    cells = cells.where(~(F.col("titled") & (F.col("k") == 0)))
    grown = lambda side: F.when(F.col("title").isNotNull() & (F.col("k") == F.col("n") - 1), F.concat_ws(" ", F.col(f"pair.{side}.text"), F.col(f"title.{side}.text"))).otherwise(F.coalesce(F.col(f"pair.{side}.text"), F.lit("")))
    numbered = lambda side: F.coalesce(F.col(f"pair.{side}.numbered"), F.lit(False))
    both = F.col("pair.en").isNotNull() & F.col("pair.ar").isNotNull()
    made = cells.select(
        "doc", "pos", "page", "row_index", "k", heading_rank(F.coalesce("pair.en.text", F.lit("")), F.coalesce("pair.ar.text", F.lit(""))).alias("own"), grown("en").alias("en"), grown("ar").alias("ar"),
        (both & (numbered("en") != numbered("ar"))).alias("mismatch"),
    )
    ranks = made.groupBy("doc", "pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "own"))), lambda x: x["own"]).alias("r"), F.min("k").alias("k0"))  # one cell's headings
    ranked = ranks.select("doc", "pos", F.posexplode(nested_ranks(F.col("r"))).alias("i", "rank"), "k0").select("doc", "pos", (F.col("i") + F.col("k0")).alias("k"), "rank")
    headings = made.join(ranked, ["doc", "pos", "k"]).select("doc", "pos", "page", "row_index", "k", "rank", "en", "ar")
    place = ["doc", "page", "row_index"]
    anomalies = seq.where("NOT cell.aligned").select(*place, F.lit("heading_alignment").alias("anomaly"))
    anomalies = anomalies.unionByName(seq.where("untitled").select(*place, F.lit("untitled_heading").alias("anomaly")))
    return headings, anomalies.unionByName(made.where("mismatch").select(*place, F.lit("numbering_mismatch").alias("anomaly")))
