"""Record-level operators: question and article picks, run identity, text-to-article sets, templates, corpus checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from corpusloom.functions.glyphs import overlap_of_heights
from corpusloom.functions.text import arabic_digits, article_references, citation, paragraph_numbers

# ---- Fixed values: they must equal the reference's for equal results. ----
CJK = "[\\u3040-\\u30ff\\u3400-\\u9fff\\uac00-\\ud7af]"
ARABIC_BLOCK = "[\\u0600-\\u06ff]"
MAX_LATIN_IN_ARABIC = 3
DOCS_ONLY = r"^(?:[^/]+\.md|docs/(?!metrics/).+)$"
AR_MONTHS = ("يناير", "فبراير", "مارس", "أبريل", "مايو", "يونيو", "يوليو", "أغسطس", "سبتمبر", "أكتوبر", "نوفمبر", "ديسمبر")
# ---- End of fixed values. ----


def pick_articles(articles: DataFrame, *, exclude: DataFrame, n: int, seed: str = "0") -> DataFrame:
    """n articles in force with both texts that are not excluded, by hash of number and seed; raises if there are fewer."""
    open_ = articles.where(~F.col("is_repealed") & (F.trim("text_ar") != "") & (F.trim("text_en") != "")).join(exclude, "article_number", "left_anti")
    picked = open_.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("article_number").cast("string")).cast("binary")), "article_number").limit(n)
    if picked.count() < n:
        raise ValueError(f"fewer than {n} articles to pick from")
    return picked


def clean_question(text: Column, language: Column) -> Column:
    """The first line, or null if its letters do not fit the language."""
    line = F.trim(F.substring_index(F.trim(text), "\n", 1))
    latin = F.regexp_count(line, F.lit("[A-Za-z]"))
    bad = line.rlike(CJK) | F.when(language == "ar", latin > MAX_LATIN_IN_ARABIC).otherwise(line.rlike(ARABIC_BLOCK)) | (line == "")
    return F.when(~bad, line)


def needs_delivery(paths: DataFrame, path: str = "path") -> DataFrame:
    """One row: true without paths, or if one is no documentation."""
    return paths.agg(F.coalesce(F.bool_or(~F.col(path).rlike(DOCS_ONLY)), F.lit(True)).alias("deliver"))


def run_identity(experiment: Column, has_git: Column, changed: Column, added: Column, removed: Column) -> Column:
    same = (F.size(changed) == 0) & (F.size(added) == 0) & (F.size(removed) == 0)
    return F.coalesce(experiment, F.when(~has_git, "unknown").when(same, "baseline").otherwise("workspace"))


def articles_of_texts(chunks: DataFrame, text: str, article: str) -> DataFrame:
    """(text, articles): one text may stand for several articles."""
    return chunks.groupBy(text).agg(F.sort_array(F.collect_set(article)).alias("articles"))


def most_common(rows: DataFrame, value: str, n: int) -> DataFrame:
    """(value, n, first_seen): commonest first, ties in order of first appearance by ``pos``."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"), F.min("pos").alias("first_seen"))
    return counts.orderBy(F.desc("n"), "first_seen", value).limit(n)


def header_shape(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9٠-٩]+", "N")


def set_digest(rows: DataFrame, id: str, digest: Column) -> DataFrame:
    """One row: SHA-256 over the rows' digests in id order.

    Rows are sorted in ranges; one task then reads the ranges one after another and hashes as it reads, so that no more
    than a batch is held. The hash is of a sequence, so this step cannot be split.
    """
    import hashlib
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = hashlib.sha256()
        for b in batches:
            total.update("".join(x for x in b.column("d").to_pylist() if x is not None).encode())
        yield pa.RecordBatch.from_pydict({"digest": [total.hexdigest()]})

    folded = rows.select(F.col(id).alias("o"), digest.alias("d")).orderBy("o", "d").select("d").coalesce(1).mapInArrow(run, "digest string")
    return folded.agg(F.coalesce(F.max("digest"), F.lit(hashlib.sha256().hexdigest())).alias("digest"))  # no task runs without rows


def lowest(rows: DataFrame, score: str, id: str, n: int = 10) -> DataFrame:
    return rows.where(F.col(score).isNotNull()).orderBy(score, id).limit(n)


def render_context(heading: Column, text_ar: Column, text_en: Column, number: Column) -> Column:
    """The article as a prompt shows it; empty parts leave no block."""
    parts = [F.concat(F.lit("## "), citation(number)), heading, text_ar, text_en]
    return F.concat_ws("\n\n", *[F.nullif(p, F.lit("")) for p in parts])


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def repeal_reply(language: Column, subject: Column, first: Column, last: Column, day: Column, law: Column) -> Column:
    """The fixed reply on a repealed range in the question's language; date and law are left out where unknown."""
    month = F.element_at(F.array(*map(F.lit, AR_MONTHS)), F.month(day))
    ar_day = F.concat_ws(" ", arabic_digits(F.dayofmonth(day)), month, arabic_digits(F.year(day)))
    clause = lambda lead, value: F.when(value.isNotNull(), F.concat(F.lit(lead), value)).otherwise("")
    ar_when = F.when(day.isNotNull(), F.concat(F.lit(" اعتبارًا من "), ar_day)).otherwise("")
    ar = F.concat(
        F.lit("كانت أحكام "), subject, F.lit(" في القانون المدني واردة في المواد من "), arabic_digits(first), F.lit(" إلى "), arabic_digits(last), F.lit("، وقد ألغيت"),
        ar_when, clause(" ", law), F.lit(". ولا يتضمن القانون المدني الحالي من هذه المواد إلا ما يفيد إلغاءها."),
    )
    en = F.concat(
        F.lit("The Civil Code's provisions on "), subject, F.lit(" were in Articles "), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(". They were repealed"),
        clause(" as of ", F.date_format(day, "d MMMM yyyy")), clause(" ", law), F.lit(". The current Code keeps only a note that these articles are repealed."),
    )
    return F.when(language == "ar", ar).otherwise(en)


def cut_sections(lines: DataFrame, headings: list[tuple[str | None, str]]) -> DataFrame:
    """(doc, section, text) of (doc, line_no, line): each heading's pattern is looked for after the one before.

    A heading without a name ends the section before it only. The cursor moves with each match: each heading's place is the
    first line that fits from the cursor on. Lines of one document are one row, in the JVM.
    """
    out = lines.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l")).withColumn("t", F.transform("l", lambda x: x["line"])).withColumn("at", F.lit(1))
    for k, (_, pattern) in enumerate(headings):
        fits = lambda i: (i >= F.col("at")) & F.element_at("t", i).rlike(pattern)  # noqa: B023, E731 - called before the next one
        out = out.withColumn(f"hit_{k}", F.array_min(F.filter(F.sequence(F.lit(1), F.size("t")), fits))).withColumn("at", F.coalesce(F.col(f"hit_{k}") + 1, "at"))
    hit = [F.col(f"hit_{k}") for k in range(len(headings))]
    end = lambda k: F.coalesce(*hit[k + 1 :], F.size("t") + 1)
    cut = lambda k: F.when(hit[k].isNotNull(), F.array_join(F.slice("t", hit[k] + 1, end(k) - hit[k] - 1), "\n"))
    parts = [F.struct(F.lit(name).alias("section"), cut(k).alias("text")) for k, (name, _) in enumerate(headings) if name is not None]
    return out.select(F.col("doc").cast("long").alias("doc"), F.inline(F.array(*parts))).where("text IS NOT NULL")


def tag_counts(spark, edges_view: str, root: str) -> DataFrame:
    """(tag, n, depth) of a tree of (parent, child, tag) by a recursive query."""
    return spark.sql(f"""
        WITH RECURSIVE walk(node, tag, depth) AS (
            SELECT child, tag, 1 FROM {edges_view} WHERE parent = '{root}'
            UNION ALL SELECT e.child, e.tag, w.depth + 1 FROM walk w JOIN {edges_view} e ON e.parent = w.node
        ) SELECT tag, count(*) AS n, max(depth) AS depth FROM walk GROUP BY tag""")


def visual_lines(pieces: DataFrame, *, rtl: bool, least: float = 0.5) -> DataFrame:
    """Adds line_no and place of (cell, pos, x0, y0, x1, y1): neighbours that overlap vertically by half of the lower are one line.

    Pieces may bring their ``height`` instead of y1; a sum y1 = y0 + height is rounded, which decides where the overlap is just half.
    """
    w = Window.partitionBy("cell").orderBy("pos")
    height = F.col("height") if "height" in pieces.columns else F.col("y1") - F.col("y0")
    share = overlap_of_heights(F.col("y0"), height, F.lag("y0").over(w), F.lag(height).over(w))
    first = F.lag("pos").over(w).isNull()  # least and greatest skip the nulls that lag gives there
    numbered = pieces.withColumn("new", (first | (share < least)).cast("int")).withColumn("line_no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    order = F.desc("x1") if rtl else F.asc("x0")
    return numbered.withColumn("place", F.row_number().over(Window.partitionBy("cell", "line_no").orderBy(order, "pos"))).drop("new")


def heading_spans(rows: DataFrame) -> DataFrame:
    """(doc, path, first, last, n): articles directly under each path."""
    return rows.groupBy("doc", "path").agg(F.min("article_number").alias("first"), F.max("article_number").alias("last"), F.count("*").alias("n"))


def corpus_checks(articles: DataFrame) -> DataFrame:
    """(check_id, n): articles that break each rule; 0 everywhere for a sound corpus.

    markers: opening markers are not 1..n; header_inside: a header line within a body; empty: a text is blank.
    """
    numbers = paragraph_numbers(F.col("text_ar"))
    ordered = (F.size(numbers) == 0) | (numbers == F.sequence(F.lit(1), F.greatest(F.size(numbers), F.lit(1))))
    inside = F.exists(F.split("text_en", "\n"), lambda x: x.rlike(r"^A?rticle\s*\d+\s*$"))
    empty = (F.trim("text_en") == "") | (F.trim("text_ar") == "")
    row = articles.agg(F.count_if(~ordered).alias("markers"), F.count_if(inside).alias("header_inside"), F.count_if(empty & ~F.col("is_repealed")).alias("empty"))
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check_id"), F.col(c).alias("n")) for c in ("markers", "header_inside", "empty")])))


def asked_articles(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, place, chunk_id): parts of the articles that a question names, in its order."""
    named = questions.select("qid", F.posexplode(article_references(F.col("question"))).alias("place", "number"))
    return named.join(chunks.select("chunk_id", "part_index", "number"), "number").select("qid", "place", "part_index", "chunk_id")


def markdown_rows(rows: DataFrame, order: list[str], *, digits: int = 3) -> DataFrame:
    """(line_no, line): a table in Markdown, sorted, as rows; the two header lines come first."""
    cell = lambda f: F.when(F.col(f.name).isNull(), "–").otherwise(F.format_string(f"%.{digits}f", F.col(f.name)) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name).cast("string"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(f) for f in rows.schema.fields]), F.lit(" |"))
    numbered = rows.select(*order, line.alias("line")).orderBy(*order).select((F.monotonically_increasing_id() + 2).alias("line_no"), "line")
    top = ["| " + " | ".join(rows.columns) + " |", "| " + " | ".join("---" for _ in rows.columns) + " |"]
    return rows.sparkSession.createDataFrame(list(enumerate(top)), "line_no long, line string").unionByName(numbered)


def markdown_table(rows: DataFrame, order: list[str], *, digits: int = 3) -> str:
    """A report table of a small aggregate as text; whole, so that a large table belongs in markdown_rows."""
    return "\n".join(r["line"] for r in markdown_rows(rows, order, digits=digits).orderBy("line_no").collect()) + "\n"


def overlay(left: Column, right: Column) -> Column:
    """Two maps as one; the right one's values win."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def passages_within(passages: Column, part: Column) -> Column:
    """Passages whose first line is in the part."""
    return F.filter(passages, lambda p: F.contains(part, F.substring_index(p, "\n", 1)))


def over_limit(rows: DataFrame, n_tokens: Column, limit: int) -> DataFrame:
    """Texts that a model would cut; a gate passes if there is none."""
    return rows.where(n_tokens > limit)


def is_bold(font: Column, flags: Column) -> Column:
    return F.contains(font, F.lit("Bold")) | (flags.bitwiseAND(16) != 0)


def all_bold(spans: Column) -> Column:
    """Whether all non-blank spans (text, font, flags) are bold; null without one."""
    real = F.filter(spans, lambda s: F.trim(s["text"]) != "")
    return F.when(F.size(real) > 0, F.forall(real, lambda s: is_bold(s["font"], s["flags"])))


def highlighted_passages(rows: DataFrame) -> DataFrame:
    """(id, passages, leftover) of (id, lines, fragments): fragments held by neighbouring lines form a passage.

    A line takes the first unused fragment that it contains; fragments that no line takes are left over. The walk
    is an ordered fold over the lines of one row.
    """
    kind = "struct<left:array<string>,out:array<string>,open:boolean>"
    start = F.struct(F.col("fragments").alias("left"), F.array().cast("array<string>").alias("out"), F.lit(False).alias("open")).cast(kind)

    def step(acc: Column, line: Column) -> Column:
        at = F.array_position(F.transform(acc["left"], lambda f: F.contains(line, f)), F.lit(True)).cast("int")
        n = F.size(acc["left"])
        hit = F.try_element_at(acc["left"], F.greatest(at, F.lit(1)))
        rest = F.concat(F.slice(acc["left"], 1, F.greatest(at - 1, F.lit(0))), F.slice(acc["left"], at + 1, F.greatest(n - at, F.lit(0))))
        grown = F.concat(F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(F.concat_ws("\n", F.try_element_at(acc["out"], F.lit(-1)), hit)))
        out = F.when(at == 0, acc["out"]).when(acc["open"], grown).otherwise(F.concat(acc["out"], F.array(hit)))
        return F.struct(F.when(at == 0, acc["left"]).otherwise(rest).alias("left"), out.alias("out"), (at > 0).alias("open")).cast(kind)

    walked = F.aggregate("lines", start, step)
    return rows.select("id", walked.alias("w")).select("id", F.col("w.out").alias("passages"), F.col("w.left").alias("leftover"))


def report_rows(rows: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """A report's rows with the columns of other tables, each joined by a label of the row to its own: (table, its label's column).

    A label that a table lacks leaves its columns null, which markdown_rows shows as a dash. A label twice in a table raises
    as it is read, so that no row doubles.
    """
    out = rows
    for label, (table, key) in tables.items():
        twice = F.count("*").over(Window.partitionBy(key)) > 1
        once = table.withColumn(key, F.when(twice, F.raise_error(F.concat(F.lit(f"{label}: label twice: "), F.col(key).cast("string")))).otherwise(F.col(key)))
        out = out.join(once.withColumnRenamed(key, f"__{label}"), F.col(label) == F.col(f"__{label}"), "left").drop(f"__{label}")
    return out


def question_requests(articles: DataFrame, *, order: str = "article_number") -> DataFrame:
    """Adds language: Arabic and English in turn by place. Articles are a picked few, numbered in one task."""
    at = F.row_number().over(Window.orderBy(order)) - 1
    return articles.withColumn("language", F.when(F.pmod(at, F.lit(2)) == 0, "ar").otherwise("en"))


def accepted_questions(requests: DataFrame, replies: DataFrame, *, attempts: int = 3) -> DataFrame:
    """(article_number, language, question): the first clean reply within so many attempts; none after a call that failed.

    replies: (article_number, attempt from 1, reply), null where the call failed.
    """
    tried = requests.select("article_number", "language").join(replies.where(F.col("attempt") <= attempts), "article_number")
    tried = tried.withColumn("clean", clean_question(F.col("reply"), F.col("language")))
    failed = F.min(F.when(F.col("reply").isNull(), F.col("attempt")))
    best = tried.groupBy("article_number", "language").agg(F.min(F.when(F.col("clean").isNotNull(), F.struct("attempt", "clean"))).alias("b"), failed.alias("failed"))
    return best.where(F.col("b").isNotNull() & (F.col("failed").isNull() | (F.col("b.attempt") < F.col("failed")))).select("article_number", "language", F.col("b.clean").alias("question"))
