"""Building a corpus from table rows: errata, repairs, classification, headings, articles, chunks.

Rows are (doc, page, row_index, en_text, ar_text, en_all_bold, ar_all_bold). Order matters only within a document,
so windows are partitioned by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import ascii_digits, range_citation
from corpusloom.operators.quantiles import percentiles
from corpusloom.operators.ranges import running
from corpusloom.sources.records import stored

# ---- Fixed values: they must equal the reference's for equal results. ----
EN_HEADER = r"^(A?)rticle(\s*)(\d+)(?![\p{L}\p{N}_])\s*([^\n]*)"
REPEALED = r"(?i)Articles\s+(\d+)\s*[-–]\s*(\d+)[^\n]*repealed"
EN_NUMBERED, AR_NUMBERED = r"^\d+\s*[.\-]", r"^[٠-٩]+\s*[-–—]"
AR_ORDINAL = r"^(أولاً|ثانياً|ثالثاً|رابعاً|خامساً)"
EN_KEYWORD = r"(?i)\b(PART|BOOK|CHAPTER|SECTION)\b"
AR_KEYWORDS = {"القسم": "PART", "الكتاب": "BOOK", "الباب": "CHAPTER", "الفصل": "SECTION"}
KEYWORD_RANKS = {"PART": 1, "BOOK": 2, "CHAPTER": 3, "SECTION": 4}
NUMBERED_RANK, PLAIN_RANK = 5, 6
AR_HEADER_ONE_LINE = r"^[\s()]*م\s*ا\s*د\s*ة[\s()]*([٠-٩]+)[\s()]*(?=\n|$)"
AR_HEADER_TWO_LINES = r"^[\s()]*م\s*ا\s*د\s*ة[\s()]*\n[\s()]*([٠-٩]+)[\s()]*(?=\n|$)"
AR_MARKER = r"^[()]\s*([١-٩][٠-٩]*)\s*[()]\s*"
# ---- End of fixed values. ----

#: Places that a heading cell has in the order of headings.
CELL_PLACES = 4096


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def classify(rows: DataFrame) -> DataFrame:
    """Adds kind, an ordered CASE. Unknown boldness of the English side leaves the decision to the Arabic side."""
    heading = F.coalesce("en_all_bold", "ar_all_bold", F.lit(False))
    kind = (
        F.when(first_line(F.coalesce("en_text", F.lit(""))).rlike(EN_HEADER), "article")
        .when(F.coalesce("en_text", F.lit("")).rlike(REPEALED), "repeal")
        .when(heading, "heading")
        .when(F.col("row_index") == 0, "continuation")
        .otherwise("anomaly")
    )
    return rows.withColumn("kind", kind)


def apply_errata(rows: DataFrame, errata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, problems): each erratum (page, row, side, expect, replace, n) replaces the one run of whole lines it expects.

    Errata of one row and side apply in the order of n. A problem is an erratum whose row is missing or whose lines
    occur not exactly once; such an erratum changes nothing.
    """
    edits = errata.groupBy(F.col("page").alias("e_page"), F.col("row").alias("e_row")).agg(F.sort_array(F.collect_list(F.struct("n", "side", "expect", "replace"))).alias("edits"))

    def framed(x: Column) -> Column:
        return F.concat(F.lit("\n"), x, F.lit("\n"))

    def times(text: Column, expect: Column) -> Column:
        # line ends are doubled so that neighbouring runs do not share one
        wide = framed(F.replace(text, F.lit("\n"), F.lit("\n\n")))
        wanted = framed(F.replace(expect, F.lit("\n"), F.lit("\n\n")))
        return F.size(F.split(wide, F.concat(F.lit("\\Q"), wanted, F.lit("\\E")), -1)) - 1

    def apply(side: str) -> Column:
        mine = F.filter(F.coalesce("edits", F.array().cast("array<struct<n:int,side:string,expect:string,replace:string>>")), lambda e: e["side"] == side)

        def step(text: Column, e: Column) -> Column:
            new = F.replace(framed(text), framed(e["expect"]), framed(e["replace"]))
            return F.when(times(text, e["expect"]) == 1, F.substr(new, F.lit(2), F.length(new) - 2)).otherwise(text)

        return F.aggregate(mine, F.col(f"{side}_text"), step)

    joined = rows.join(edits, (F.col("page") == F.col("e_page")) & (F.col("row_index") == F.col("e_row")), "left")
    fixed = joined.withColumns({"en_text": apply("en"), "ar_text": apply("ar")}).drop("edits", "e_page", "e_row")
    place = errata.alias("e").join(rows.alias("r"), (F.col("e.page") == F.col("r.page")) & (F.col("e.row") == F.col("r.row_index")), "left")
    found = times(F.when(F.col("e.side") == "en", F.col("r.en_text")).otherwise(F.col("r.ar_text")), F.col("e.expect"))
    problems = place.select("e.*", F.coalesce(found, F.lit(0)).alias("found")).where("found <> 1")
    return fixed, problems


def repair(rows: DataFrame) -> DataFrame:
    """Article rows get their header on a line of its own in both languages; opening markers become ``(N) ``.

    Adds counts: header_split, ar_header_fixed, markers_fixed.
    """
    en, ar = F.col("en_text"), F.col("ar_text")
    is_article = first_line(en).rlike(EN_HEADER)
    body = F.regexp_extract(first_line(en), EN_HEADER, 4)
    split = is_article & (body != "")
    head = F.rtrim(F.substr(first_line(en), F.lit(1), F.length(first_line(en)) - F.length(body)))
    new_en = F.when(split, F.concat(head, F.lit("\n"), F.substr(en, F.length(first_line(en)) - F.length(body) + 1))).otherwise(en)
    one, two = F.regexp_extract(ar, AR_HEADER_ONE_LINE, 1), F.regexp_extract(ar, AR_HEADER_TWO_LINES, 1)
    fixed_ar = (
        F.when(is_article & (one != ""), F.regexp_replace(ar, AR_HEADER_ONE_LINE, "مادة $1")).when(is_article & (two != ""), F.regexp_replace(ar, AR_HEADER_TWO_LINES, "مادة $1")).otherwise(ar)
    )
    out = rows.withColumns({"__en": new_en, "__ar": fixed_ar})
    lines = F.split("__ar", "\n", -1)
    marked = F.transform(lines, lambda x: F.rtrim(F.regexp_replace(x, AR_MARKER, "($1) ")))
    keep = F.zip_with(lines, marked, lambda a, b: F.when(a.rlike(AR_MARKER), b).otherwise(a))
    return out.select(
        *[c for c in rows.columns if c not in ("en_text", "ar_text")],
        F.col("__en").alias("en_text"),
        F.array_join(keep, "\n").alias("ar_text"),
        split.alias("header_split"),
        (F.col("__ar") != ar).alias("ar_header_fixed"),
        F.size(F.filter(F.zip_with(lines, keep, lambda a, b: a != b), lambda x: x)).alias("markers_fixed"),
    )


def heading_rank(en: Column, ar: Column) -> Column:
    """1 to 4 by keyword, else 5 if either side is numbered, else 6."""
    english = F.upper(F.regexp_extract(en, EN_KEYWORD, 1))
    arabic = F.element_at(F.create_map(*[F.lit(x) for p in AR_KEYWORDS.items() for x in p]), F.regexp_extract(ar, "^(" + "|".join(AR_KEYWORDS) + ")(?![\\p{L}\\p{N}_])", 1))
    rank = F.element_at(F.create_map(*[F.lit(x) for p in KEYWORD_RANKS.items() for x in p]), F.coalesce(F.nullif(english, F.lit("")), arabic))
    numbered = F.coalesce(en.rlike(EN_NUMBERED), F.lit(False)) | F.coalesce(ar.rlike(AR_NUMBERED) | ar.rlike(AR_ORDINAL), F.lit(False))
    return F.coalesce(rank, F.when(numbered, NUMBERED_RANK).otherwise(PLAIN_RANK))


def heading_paths(headings: DataFrame, *, max_rank: int = 10, range_size: int = 65_536) -> DataFrame:
    """Adds path, the open headings' labels root first. rows: (doc, pos, rank, label).

    A heading closes all open ones of its rank or more. So the heading of rank k is open at a place if it is the
    last of its rank, and none of a lower rank came after it: a running maximum per rank, no stack. A document is
    cut into ranges of places, which take over the open headings of those before them.
    """
    last = {f"__h{k}": F.when(F.col("rank") == k, F.struct("pos", "label")) for k in range(1, max_rank + 1)}
    rows = running(headings, ["doc"], ["pos"], F.floor(F.col("pos") / range_size), maxima=last)
    open_ = []
    for k in range(1, max_rank + 1):
        lower = [F.col(f"__h{j}")["pos"] for j in range(1, k)]
        above = F.coalesce(F.greatest(*lower), F.lit(-1)) if len(lower) > 1 else (F.coalesce(lower[0], F.lit(-1)) if lower else F.lit(-1))
        open_.append(F.when(F.col(f"__h{k}")["pos"] > above, F.col(f"__h{k}")["label"]))
    path = F.filter(F.array(*open_), lambda x: x.isNotNull())
    return rows.withColumn("path", path).drop(*last)


def nested_ranks(ranks: Column) -> Column:
    """Within one cell each heading nests under the one before: rank = max(rank, previous + 1)."""
    start = F.array().cast("array<int>")
    return F.aggregate(
        ranks,
        start,
        lambda acc, r: F.concat(acc, F.array(F.when(F.size(acc) == 0, r).otherwise(F.greatest(r, F.element_at(acc, -1) + 1)))),
    )


def assemble(rows: DataFrame, *, pages: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(articles, anomalies) of classified rows.

    A continuation joins the unit before it if that is an article; a heading before it, or nothing, makes it an
    orphan. Heading rows open paths, heading by heading as headings.heading_rows finds them; an article has the path of
    the last one before it, in English. Rows are numbered by page and row, which tell a document's rows apart. A document is
    cut into ranges of so many pages; a range takes over the open unit and path of those before it. Rows are stored once, with a
    number each: what runs over a document is found without texts, which then come to their units by that number.
    """
    from corpusloom.operators.headings import heading_rows

    numbers = {
        "number": F.when(F.col("kind") == "article", F.regexp_extract(first_line(F.col("en_text")), EN_HEADER, 3).cast("int")),
        "gone_from": F.when(F.col("kind") == "repeal", F.regexp_extract("en_text", REPEALED, 1).cast("int")),
        "gone_to": F.when(F.col("kind") == "repeal", F.regexp_extract("en_text", REPEALED, 2).cast("int")),
    }
    place, span = ["page", "row_index"], F.floor(F.col("page") / pages)
    cells = rows.select("doc", *place, "kind", "en_text", "ar_text", *[c.alias(n) for n, c in numbers.items()])
    rows = stored(cells.withColumn("row", F.monotonically_increasing_id()), "classified")
    opens = F.col("kind").isin("article", "heading", "repeal")
    seq = running(rows.drop("en_text", "ar_text"), ["doc"], place, span, sums={"pos": F.lit(1), "unit": opens.cast("int")}, lasts={"unit_kind": F.when(opens, F.col("kind"))})
    seq = seq.withColumn("pos", F.col("pos").cast("int"))
    heads, odd = heading_rows(rows, pages=pages)
    # places within a cell follow each other between two rows
    at = F.col("pos").cast("long") * CELL_PLACES + F.col("k")
    paths = heading_paths(heads.select("doc", at.alias("pos"), "rank", F.nullif("en", F.lit("")).alias("label")))
    ends = paths.withColumn("h_pos", F.floor(F.col("pos") / CELL_PLACES).cast("int")).groupBy("doc", "h_pos").agg(F.max_by("path", "pos").alias("path"))
    seq = seq.join(ends.withColumnRenamed("h_pos", "pos"), ["doc", "pos"], "left")
    # a heading row whose only heading is the title of the one before has that one's path
    seq = running(stored(seq, "paths"), ["doc"], place, span, lasts={"path": F.col("path")})
    joins = (F.col("kind") == "article") | ((F.col("kind") == "continuation") & (F.col("unit_kind") == "article"))
    texts = lambda *kinds: rows.where(F.col("kind").isin(*kinds)).select("row", "en_text", "ar_text")
    # each column is an aggregate of its own, so that what is not asked for is not gathered
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("pos", c))), lambda p: p[c])
    units = seq.where(joins).join(texts("article", "continuation"), "row").groupBy("doc", "unit")
    articles = units.agg(
        F.min_by("number", "pos").alias("article_number"),
        F.array_join(listed("en_text"), "\n").alias("text_en"),
        F.array_join(listed("ar_text"), "\n").alias("text_ar"),
        F.coalesce(F.first("path"), F.array().cast("array<string>")).alias("heading_path"),
        F.array_distinct(listed("page")).alias("source_pages"),
        F.lit(False).alias("is_repealed"),
    ).drop("unit")
    gone = seq.where("kind = 'repeal'").join(texts("repeal"), "row").select(
        "doc",
        F.explode(F.sequence("gone_from", "gone_to")).alias("article_number"),
        F.col("en_text").alias("text_en"),
        F.col("ar_text").alias("text_ar"),
        F.coalesce("path", F.array().cast("array<string>")).alias("heading_path"),
        F.array("page").alias("source_pages"),
        F.lit(True).alias("is_repealed"),
    )
    kind = F.when(F.col("kind") == "anomaly", "unclassified").when((F.col("kind") == "continuation") & (F.coalesce("unit_kind", F.lit("")) != "article"), "orphan_continuation")
    anomalies = seq.withColumn("anomaly", kind).where("anomaly IS NOT NULL").select("doc", "page", "row_index", "anomaly")
    return articles.unionByName(gone), anomalies.unionByName(odd)


def merge_repealed(articles: DataFrame, *, range_size: int = 4096) -> DataFrame:
    """Runs of consecutive repealed articles with equal texts as one row (article_number, range_end, citation, n).

    A document is cut into ranges of article numbers; a range takes over the last article of the one before it. Of rows of one
    number the order is that of the texts. Texts of articles in force decide nothing and are not moved.
    """
    text = {c: F.when(F.col("is_repealed"), F.col(c)).alias(c) for c in ("text_en", "text_ar")}
    articles = articles.select("doc", "article_number", "is_repealed", *text.values())
    span, order = F.floor(F.col("article_number") / range_size), ["article_number", "is_repealed", "text_en", "text_ar"]
    here = F.struct("article_number", "is_repealed", "text_ar", "text_en")
    before = running(articles, ["doc"], order, span, lags={"__before": here})
    same = (
        F.col("is_repealed")
        & F.col("__before.is_repealed")
        & (F.col("article_number") == F.col("__before.article_number") + 1)
        & F.col("text_ar").eqNullSafe(F.col("__before.text_ar"))
        & F.col("text_en").eqNullSafe(F.col("__before.text_en"))
    )
    marked = before.withColumn("new", (~F.coalesce(same, F.lit(False))).cast("int")).drop("__before")
    runs = running(marked, ["doc"], order, span, sums={"run": F.col("new")})
    out = runs.groupBy("doc", "run").agg(F.min("article_number").alias("article_number"), F.max("article_number").alias("last"), F.count("*").alias("n"))
    return out.select(
        "doc",
        "article_number",
        F.when(F.col("n") > 1, F.col("last")).alias("range_end"),
        F.when(F.col("n") > 1, range_citation(F.col("article_number"), F.col("last"))).alias("citation"),
        "n",
    )


def islands(rows: DataFrame, value: str, by: list[str], *, range_size: int = 65_536) -> DataFrame:
    """(by, first, last, n): runs of consecutive integers.

    Runs are found within ranges of values; only those that touch an end of their range meet others, in a window by group.
    """
    distinct = rows.select(*by, F.col(value).cast("long").alias("v")).distinct().withColumn("range", F.floor(F.col("v") / range_size))
    w = Window.partitionBy(*by, "range").orderBy("v")
    runs = distinct.withColumn("run", F.col("v") - F.row_number().over(w)).groupBy(*by, "range", "run").agg(F.min("v").alias("first"), F.max("v").alias("last"), F.count("*").alias("n"))
    touches = (F.pmod("first", F.lit(range_size)) == 0) | (F.pmod("last", F.lit(range_size)) == range_size - 1)
    order = Window.partitionBy(*by).orderBy("first")
    new = F.coalesce((F.col("first") != F.lag("last").over(order) + 1).cast("int"), F.lit(1))
    joined = runs.where(touches).withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    edges = joined.groupBy(*by, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return runs.where(~touches).select(*by, "first", "last", "n").unionByName(edges.select(*by, "first", "last", "n"))


def semantic_breaks(rows: DataFrame, *, doc: str, pos: str, vector: str, percentile: float, range_size: int = 65_536) -> DataFrame:
    """Adds distance (to the row before, 6 digits) and group: a new one where it exceeds the corpus-wide percentile.

    Places are whole numbers. A document is cut into ranges of places; a range takes over the last vector and the groups of
    those before it. Rows with their distances are stored once.
    """
    from corpusloom.functions.vectors import dot, norm

    span = F.floor(F.col(pos) / range_size)
    before = F.col("__before")
    far = 1 - F.coalesce(F.try_divide(dot(before, F.col(vector)), norm(before) * norm(F.col(vector))), F.lit(1.0))
    placed = running(rows, [doc], [pos], span, lags={"__before": F.col(vector)}).withColumn("distance", F.when(before.isNotNull(), F.round(far, 6))).drop("__before")
    placed = stored(placed, "distances")
    limit = percentiles(placed, F.col("distance"), [], [percentile / 100]).select(F.col("p")[0].alias("limit"))
    cut = F.coalesce((F.col("distance") > F.col("limit")).cast("int"), F.lit(0))
    # limit is one row
    cuts = placed.crossJoin(F.broadcast(limit)).withColumn("__cut", cut).drop("limit")
    return running(cuts, [doc], [pos], span, sums={"group": F.col("__cut")}).withColumn("group", F.col("group") + 1).drop("__cut")


def append_checked(old: DataFrame, new: DataFrame, *, id: str) -> tuple[DataFrame, DataFrame]:
    """(union, clashes): rows of both tables; ids of the new table that repeat, there or in the old one, are clashes and stay out."""
    twice = new.groupBy(id).agg(F.count("*").alias("n")).where("n > 1").select(id)
    clashes = new.join(old.select(id).distinct(), id, "left_semi").select(id).unionByName(twice).distinct()
    return old.unionByName(new.join(clashes, id, "left_anti")), clashes


def digits_of_header(ar_text: Column) -> Column:
    """The number of a repaired Arabic header."""
    return F.try_to_number(ascii_digits(F.regexp_extract(ar_text, r"^مادة\s*([٠-٩]+)$", 1)), F.lit("999999")).cast("int")
