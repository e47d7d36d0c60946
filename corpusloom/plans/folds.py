"""Queries of ordered folds and glyph repairs, over inputs made from the given tables by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import glyphs, text as T
from corpusloom.operators import evaluate as E, headings as H, records as O
from corpusloom.plans.common import Query, read, spread
from corpusloom.plans.text import TOKENS


def balanced_split(spark, d):
    """The benchmark's items in halves: two of three are a pair, kinds and registers by the length of their text."""
    i, n = F.col("item_id"), F.length("text")
    pair = F.when(i % 3 < 2, F.concat(F.lit("p"), F.floor(i / 3).cast("string")))
    rows = read(spark, d, "benchmark").select(F.lpad(i.cast("string"), 9, "0").alias("qid"), pair.alias("pair_id"), F.concat(F.lit("k"), (n % 3).cast("string")).alias("kind"), F.concat(F.lit("r"), (n % 2).cast("string")).alias("register"))
    return E.balanced_split(rows)


LATIN, ARABIC = "abcdefghijklmnopqrstuvwxyz0123456789", "ابجدهوزحطيكلمنسعفصقرشتثخذض٠١٢٣٤٥٦٧٨٩"


def glyph_repair(spark, d):
    """The documents' distinct words in Arabic letters, as a broken extraction gives them: lam and alef swapped, digits from the right, a space before the first letter."""
    words = spread(read(spark, d, "documents")).select(F.explode(T.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    unit = F.regexp_extract_all("word", F.lit("la|[0-9]+|."), F.lit(0))
    glyph = lambda c, x0, width: F.struct(F.translate(c, LATIN, ARABIC).alias("c"), x0.cast("double").alias("x0"), (x0 + width).cast("double").alias("x1"))

    def drawn(u, i):
        x = F.lit(10_000_000) - i * 1000
        number = F.reverse(F.transform(F.split(u, ""), lambda c, k: glyph(c, x + k * 5, 4)))
        return F.when(u == "la", F.array(glyph(F.lit("a"), x, 0), glyph(F.lit("l"), x, 4))).when(u.rlike("^[0-9]"), number).otherwise(F.array(glyph(u, x, 4)))

    units = F.filter(unit, lambda u: u != "")
    space = F.array(glyph(F.lit(" "), F.lit(10_000_000 - 500), 4))
    piece = F.concat(F.when(F.size(units) > 1, space).otherwise(F.slice(space, 1, 0)), F.flatten(F.transform(units, drawn)))
    # dealt anew, so that the Python function gets a column, not the expression
    return words.select("word", "n", piece.cast(glyphs.GLYPHS).alias("piece")).hint("rebalance").select("word", "n", glyphs.repair_glyphs("piece").alias("text"))


def cut_sections(spark, d):
    """Each document from its first line that begins with A to the next that begins with E, and from there to the next with T."""
    rows = spread(read(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")).select("doc", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    out = O.cut_sections(rows, [("one", "^[Aa]"), ("two", "^[Ee]"), (None, "^[Tt]")])
    return out.select("doc", "section", F.md5(F.col("text").cast("binary")).alias("digest"))


def heading_units(spark, d):
    """Headings of two languages from each document's words: numbered twice, wrapped in one language, a keyword with its title, one side alone."""
    word = lambda i: F.coalesce(F.get(F.col("w"), i), F.lit("word"))
    listed = F.regexp_extract_all("text", F.lit("[a-z]{4,}"), F.lit(0))
    rows = spread(read(spark, d, "documents")).select(F.col("doc_id").alias("id"), listed.alias("w")).select("id", word(0).alias("a"), word(1).alias("b"), (F.col("id") % 4).alias("form"))
    text = lambda *parts: F.concat(*[F.col(p) if p in "ab" else F.lit(p) for p in parts])
    en = F.when(F.col("form") == 0, text("1. ", "a", "\n2. ", "b")).when(F.col("form") == 1, text("1- ", "a", "\n", "b")).when(F.col("form") == 2, text("PART I\n", "a")).otherwise(text("a"))
    ar = F.when(F.col("form") == 0, F.lit("١- نطاق\n٢- عقد")).when(F.col("form") == 1, F.lit("١ -العلاقة")).when(F.col("form") == 2, F.lit("القسم الأول\nعام")).otherwise(F.lit(""))
    cell = H.aligned(H.units(H.cell_lines(en), "en"), H.units(H.cell_lines(ar), "ar"))
    name = lambda u: F.coalesce(u["text"], F.lit("-"))
    return rows.select("id", cell.alias("c")).select("id", F.array_join(F.transform("c.pairs", lambda p: F.concat(name(p["en"]), F.lit("="), name(p["ar"]))), "|").alias("units"), "c.aligned")


def highlighted_passages(spark, d):
    """Lines of documents with the first words of two of three lines as fragments, and one that no line has."""
    lines = F.split("text", "\n", -1)
    marked = F.filter(lines, lambda x, i: (i % 3 < 2) & (F.substring_index(x, " ", 1) != ""))
    fragments = F.array_append(F.transform(marked, lambda x: F.substring_index(x, " ", 1)), F.lit("\t"))
    rows = spread(read(spark, d, "documents").where("text IS NOT NULL")).select(F.col("doc_id").alias("id"), lines.alias("lines"), fragments.alias("fragments"))
    out = O.highlighted_passages(rows)
    return out.select("id", F.size("passages").cast("long").alias("n"), F.md5(F.array_join("passages", "|").cast("binary")).alias("digest"), F.size("leftover").cast("long").alias("left_over"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (balanced_split, glyph_repair, cut_sections, heading_units, highlighted_passages)}

LINES = "SELECT doc_id AS doc, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL"
AFTER = "coalesce(list_min(list_filter(range(len(l)), lambda i: i > {at} AND regexp_matches(l[i + 1], '^[{letters}]'))), {none})"
ORACLES: dict[str, str] = {
    "balanced_split": """WITH RECURSIVE q AS (
            SELECT lpad(item_id::VARCHAR, 9, '0') AS qid, CASE WHEN item_id % 3 < 2 THEN 'p' || (item_id // 3) ELSE lpad(item_id::VARCHAR, 9, '0') END AS unit, length(text) % 3 AS k, length(text) % 2 AS r FROM benchmark
        ), u AS (
            SELECT unit, row_number() OVER (ORDER BY min(qid)) AS i, arg_min(k, qid) AS k, count(*) FILTER (k = 0) AS a0, count(*) FILTER (k = 1) AS a1, count(*) FILTER (k = 2) AS a2, count(*) FILTER (r = 0) AS b0, count(*) FILTER (r = 1) AS b1 FROM q GROUP BY unit
        ), s AS (
            SELECT 0::BIGINT AS i, NULL::VARCHAR AS unit, 0::BIGINT AS sign, 0::BIGINT AS k0, 0::BIGINT AS k1, 0::BIGINT AS k2, 0::BIGINT AS r0, 0::BIGINT AS r1
            UNION ALL
            SELECT i, unit, sign, k0 + sign * a0, k1 + sign * a1, k2 + sign * a2, r0 + sign * b0, r1 + sign * b1 FROM (
                SELECT u.i, u.unit, s.k0, s.k1, s.k2, s.r0, s.r1, a0, a1, a2, b0, b1, CASE WHEN
                    (abs(CASE k WHEN 0 THEN k0 + a0 WHEN 1 THEN k1 + a1 ELSE k2 + a2 END), abs(r0 + b0) + abs(r1 + b1)) <= (abs(CASE k WHEN 0 THEN k0 - a0 WHEN 1 THEN k1 - a1 ELSE k2 - a2 END), abs(r0 - b0) + abs(r1 - b1)) THEN 1 ELSE -1 END AS sign
                FROM s JOIN u ON u.i = s.i + 1
            )
        ) SELECT qid, CASE WHEN sign = 1 THEN 'tuning' ELSE 'heldout' END AS half FROM q JOIN s USING (unit)""",
    "glyph_repair": f"""WITH w AS (SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest({TOKENS}) AS word FROM documents) GROUP BY word), p AS (SELECT word, n, regexp_extract_all(word, 'la|[0-9]+|.') AS u FROM w)
        SELECT word, n, translate(CASE WHEN len(u) > 1 THEN u[1] || ' ' || array_to_string(u[2:], '') ELSE word END, '{LATIN}', '{ARABIC}') AS text FROM p""",
    "cut_sections": f"""WITH l AS ({LINES}), a AS (SELECT *, {AFTER.format(at=-1, letters='Aa', none='NULL')} AS s1 FROM l), b AS (SELECT *, {AFTER.format(at='coalesce(s1, -1)', letters='Ee', none='NULL')} AS s2 FROM a),
        c AS (SELECT *, {AFTER.format(at='coalesce(s2, s1, -1)', letters='Tt', none='NULL')} AS s3 FROM b)
        SELECT doc, 'one' AS section, md5(coalesce(array_to_string(l[s1 + 2:coalesce(s2, s3, len(l))], chr(10)), '')) AS digest FROM c WHERE s1 IS NOT NULL
        UNION ALL SELECT doc, 'two', md5(coalesce(array_to_string(l[s2 + 2:coalesce(s3, len(l))], chr(10)), '')) FROM c WHERE s2 IS NOT NULL""",
    "heading_units": """WITH w AS (SELECT doc_id AS id, regexp_extract_all(text, '[a-z]{4,}') AS w FROM documents), x AS (SELECT id, coalesce(w[1], 'word') AS a, coalesce(w[2], 'word') AS b FROM w)
        SELECT id, CASE id % 4 WHEN 0 THEN '1. ' || a || '=١- نطاق|2. ' || b || '=٢- عقد' WHEN 1 THEN '1- ' || a || ' ' || b || '=١ -العلاقة' WHEN 2 THEN 'PART I ' || a || '=القسم الأول عام' ELSE a || '=-' END AS units, true AS aligned FROM x""",
    "highlighted_passages": f"""WITH RECURSIVE d AS ({LINES}), f AS (
            SELECT doc, l, list_append(list_filter(list_transform(list_filter(list_zip(l, range(len(l))), lambda p: p[2] % 3 < 2), lambda p: string_split(p[1], ' ')[1]), lambda w: w <> ''), chr(9)) AS f FROM d
        ), s AS (
            SELECT doc, l, f, 0::BIGINT AS i, false AS open, 0::BIGINT AS n, '' AS shown FROM f
            UNION ALL
            SELECT doc, l, CASE WHEN pos IS NULL THEN f ELSE f[:pos - 1] || f[pos + 1:] END, i + 1, pos IS NOT NULL, CASE WHEN pos IS NULL OR open THEN n ELSE n + 1 END,
                CASE WHEN pos IS NULL THEN shown WHEN open THEN shown || chr(10) || f[pos] WHEN n = 0 THEN f[pos] ELSE shown || '|' || f[pos] END
            FROM (SELECT *, list_min(list_filter(range(1, len(f) + 1), lambda k: contains(l[i + 1], f[k]))) AS pos FROM s WHERE i < len(l))
        ) SELECT doc AS id, n, md5(shown) AS digest, len(f)::BIGINT AS left_over FROM s WHERE i = len(l)""",
}
