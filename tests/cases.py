"""Cases by hand: small literal inputs and what the operators make of them, as VALUES."""

from __future__ import annotations


import uuid
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import glyphs, pii as P, text as T, text_udf as U
from corpusloom.operators import corpus as C, evaluate as E, headings as H, quality as Q, records as O, retrieval as R
from corpusloom.plans.common import long, values_sql

STEMS = [("والعقد", "عقد"), ("فالعقد", "عقد"), ("بالعقد", "عقد"), ("العقد", "عقد"), ("وعقد", "عقد"), ("وقف", "وقف"), ("بيع", "بيع"), ("فرد", "فرد"), ("الي", "الي"), ("law", "law")]
UNICODE = [(1, "ﻻ", "لا"), (2, "é", "é"), (3, "a​b", "ab"), (4, "كـــتاب", "كتاب"), (5, "  a \t b \n\n c ", "a b\nc"), (6, "ﷲ", "الله")]
FOLDS = [(1, "أحمد إلى آخر", "احمد الي اخر"), (2, "مَادَّةٌ", "ماده"), (3, "المادة ١٤٧", "الماده 147"), (4, "۱۲", "12"), (5, "Plain", "Plain")]
REFERENCES = [(1, "المادة ٢٢٢", [222]), (2, "Article 147 and art. 5", [147, 5]), (3, "Articles 221 and 222", []), (4, "7 percent in 1948", []), (5, "والمادة (٩) ثم Article 3 ثم المادة ٩", [9, 3]), (6, "particle 5", [])]
CITED = [(1, "Articles 221 and 222 or Article 5", [221, 222, 5]), (2, "المادتين ٢٢١ ، ٢٢٢", [221, 222]), (3, "المواد من ١٠٤٠ إلى ١٠٤٢", [1040, 1042]), (4, "مواد من عنده", []), (5, "Article 3, Articles 466 to 468", [3, 466, 468])]
LANGUAGES = [(1, "ما هي المادة Article 147", "ar"), (2, "What is Article 147", "en"), (3, "", "en"), (4, "عقد two three", "en"), (5, "١٢ ١٣", "en")]
ROWS = [  # page, row_index, en, ar, en bold, ar bold, kind
    (1, 0, "PART I\nGeneral", "القسم الأول", True, True, "heading"),
    (1, 1, "Article 1\nFirst text", "مادة ١\nنص", False, False, "article"),
    (1, 2, "1. Scope", "١- نطاق", None, True, "heading"),
    (1, 3, "Article 2 Same line", "مادة ٢\n(١) أ", False, False, "article"),
    (2, 0, "goes on", "يتبع", False, False, "continuation"),
    (2, 1, "Articles 3 - 5 were repealed", "ألغيت", False, False, "repeal"),
    (2, 2, "stray", "x", False, None, "anomaly"),
]
PATHS = [  # pos, rank, label, path
    (1, 1, "P1", ["P1"]), (2, 2, "B1", ["P1", "B1"]), (3, 4, "S1", ["P1", "B1", "S1"]), (4, 3, "C1", ["P1", "B1", "C1"]), (5, 6, "x", ["P1", "B1", "C1", "x"]),
    (6, 2, "B2", ["P1", "B2"]), (7, 5, "n", ["P1", "B2", "n"]), (8, 1, "P2", ["P2"]), (9, 6, "y", ["P2", "y"]),
]
CER = [(1, "kitten", "sitting"), (2, "flaw", "lawn"), (3, "same", "same"), (4, "", "abc")]
PII = [
    (1, "call +20 10 1234 5678 now", "call [phone] now"), (2, "id 29001011234567 ok", "id [national_id] ok"), (3, "id 29013011234567 no", "id 29013011234567 no"),
    (4, "mail a.b@c.org", "mail [email]"), (5, "السيد محمد علي حسن حضر", "السيد [name] حضر"), (6, "nothing here", "nothing here"), (7, None, None),
]
NUMBERS_LIST = lambda rows: values_sql([(i, ",".join(map(str, n))) for i, _, n in rows], "id, numbers")
QUESTIONS = [(1, "ما هي المادة ٥؟\nsecond", "ar", "ما هي المادة ٥؟"), (2, "سؤال about long latin", "ar", None), (3, "What is this?", "en", "What is this?"), (4, "What هذا", "en", None), (5, "漢字", "en", None), (6, "", "en", None)]
RUNS = [(1, "exp", True, [], [], [], "exp"), (2, None, True, [], [], [], "baseline"), (3, None, True, ["k"], [], [], "workspace"), (4, None, False, [], [], [], "unknown")]
ARTICLES = [(1, "one", "(١) أ\n(٢) ب", False), (2, "x\nArticle 3\ny", "(١) أ\n(٣) ب", False), (3, "", "ب", False), (4, "", "", True), (5, "t", "نص", False)]
LISTS = [("q1", 1, "a1"), ("q1", 2, "b"), ("q1", 3, "c"), ("q2", 1, "b")]
CITES = [("a1", ["c", "d"]), ("b", []), ("c", ["e"]), ("d", ["f"])]
EXPANDED = [("q1", 1, "a1", None), ("q1", 2, "c", "a1"), ("q1", 3, "d", "a1"), ("q1", 4, "b", None), ("q2", 1, "b", None)]
BASE_PARAMS = [("k", "60"), ("depth", "30"), ("old", "1"), ("stamp", "a")]
RUN_PARAMS = [("k", "10"), ("depth", "30"), ("new", "2"), ("stamp", "b")]
GATES = [
    (1, "ci", 30, 30, 0.8, "tuning", 0.75, 65, "tuning", 0.754, True, "pass", True),
    (2, "ci", 30, 30, 0.7, "tuning", 0.75, 65, "tuning", 0.754, False, "pass", False),
    (3, "ci", 30, 30, 0.8, "tuning", 0.6, 65, "tuning", 0.754, True, "fail", False),
    (4, "ci", 30, 30, 0.8, "heldout", 0.75, 65, "tuning", 0.754, True, "fail", False),
    (5, "ci", 30, 30, 0.8, "tuning", 0.75, 65, None, None, True, "skip", True),
    (6, "ci", 30, 29, None, "tuning", 0.75, 65, "tuning", 0.754, False, "pass", False),
]


def typed_rows(spark) -> DataFrame:
    kind = "doc int, page int, row_index int, en_text string, ar_text string, en_all_bold boolean, ar_all_bold boolean"
    return spark.createDataFrame([(1, *r[:6]) for r in ROWS], kind)


def light_stem(spark, d):
    return spark.createDataFrame([(w,) for w, _ in STEMS], "word string").select("word", T.light_stem(F.col("word")).alias("stem"))


def normalize_unicode(spark, d):
    return spark.createDataFrame([x[:2] for x in UNICODE], "id long, text string").select("id", U.normalize_unicode("text").alias("clean"))


def fold_arabic(spark, d):
    return spark.createDataFrame([x[:2] for x in FOLDS], "id long, text string").select("id", T.fold(F.col("text")).alias("folded"))


def article_references(spark, d):
    rows = spark.createDataFrame([x[:2] for x in REFERENCES], "id long, question string")
    return rows.select("id", F.array_join(T.article_references(F.col("question")).cast("array<string>"), ",").alias("numbers"))


def cited_articles(spark, d):
    rows = spark.createDataFrame([x[:2] for x in CITED], "id long, text string")
    return rows.select("id", F.array_join(T.cited_articles(U.fold_unicode("text")).cast("array<string>"), ",").alias("numbers"))


def question_language(spark, d):
    return spark.createDataFrame([x[:2] for x in LANGUAGES], "id long, question string").select("id", T.question_language(F.col("question")).alias("language"))


def cer_near_copies(spark, d):
    rows = spark.createDataFrame(CER, "id long, got string, gold string")
    return Q.character_error_rate(rows, "got", "gold").select("edits", "gold_chars", F.round("cer", 6).alias("cer"))


def pii_redact(spark, d):
    return spark.createDataFrame([x[:2] for x in PII], "id long, text string").select("id", P.redact(F.col("text")).alias("shown"))


def classify_rows(spark, d):
    return C.classify(typed_rows(spark)).select("page", "row_index", "kind")


def heading_paths(spark, d):
    rows = spark.createDataFrame([(1, *r[:3]) for r in PATHS], "doc int, pos int, rank int, label string")
    return C.heading_paths(rows).select("pos", F.array_join("path", " > ").alias("path"))


def assemble_articles(spark, d):
    articles, _ = C.assemble(C.classify(typed_rows(spark)))
    return articles.select("article_number", F.length("text_en").cast("long").alias("n_en"), F.array_join("heading_path", " > ").alias("path"), F.size("source_pages").cast("long").alias("pages"), "is_repealed")


def assembly_anomalies(spark, d):
    _, anomalies = C.assemble(C.classify(typed_rows(spark)))
    return anomalies.select("page", "row_index", "anomaly")


def repealed_ranges(spark, d):
    articles, _ = C.assemble(C.classify(typed_rows(spark)))
    return C.merge_repealed(articles).select("article_number", "range_end", "citation", "n")


def repair_rows(spark, d):
    fixed = C.repair(typed_rows(spark).where("en_text LIKE 'Article%'"))
    return fixed.select("page", "row_index", "en_text", "ar_text", "header_split", long("markers_fixed"))


def errata(spark, d):
    edits = spark.createDataFrame([(1, 1, 1, "en", "First text", "Better text"), (2, 2, 0, "en", "absent", "x")], "n int, page int, row int, side string, expect string, replace string")
    fixed, _ = C.apply_errata(typed_rows(spark), edits)
    return fixed.where("row_index < 2").select("page", "row_index", "en_text")


def clean_questions(spark, d):
    rows = spark.createDataFrame([q[:3] for q in QUESTIONS], "id int, question string, language string")
    return rows.select("id", O.clean_question(F.col("question"), F.col("language")).alias("clean"))


def run_identities(spark, d):
    rows = spark.createDataFrame([r[:6] for r in RUNS], "id int, experiment string, git boolean, changed array<string>, added array<string>, removed array<string>")
    return rows.select("id", O.run_identity(F.col("experiment"), F.col("git"), F.col("changed"), F.col("added"), F.col("removed")).alias("name"))


def delivery_scope(spark, d):
    sets = [(1, ["README.md", "docs/a.txt"]), (2, ["docs/metrics/x.json"]), (3, ["src/a.py", "README.md"])]
    rows = spark.createDataFrame([(i, p) for i, ps in sets for p in ps], "id int, path string")
    one = [O.needs_delivery(rows.where(F.col("id") == i)).withColumn("id", F.lit(i)) for i in (1, 2, 3, 4)]
    return one[0].unionByName(one[1]).unionByName(one[2]).unionByName(one[3])


def nested_ranks(spark, d):
    rows = spark.createDataFrame([(1, [3, 3, 2, 6]), (2, [1]), (3, [])], "id int, ranks array<int>")
    return rows.select("id", F.array_join(C.nested_ranks(F.col("ranks")).cast("array<string>"), ",").alias("nested"))


def heading_spans(spark, d):
    articles, _ = C.assemble(C.classify(typed_rows(spark)))
    out = O.heading_spans(articles.select("doc", F.array_join("heading_path", " > ").alias("path"), "article_number"))
    return out.select("path", "first", "last", "n")


def row_classes(spark, d):
    return C.classify(typed_rows(spark)).groupBy("kind").agg(F.count("*").alias("n"))


def corpus_checks(spark, d):
    rows = spark.createDataFrame(ARTICLES, "article_number int, text_en string, text_ar string, is_repealed boolean")
    return O.corpus_checks(rows)


def asked_articles(spark, d):
    asked = spark.createDataFrame([("q1", "Article 4 and المادة ٣"), ("q2", "none")], "qid string, question string")
    chunks = R.covered(spark.createDataFrame([("art-3-5", 0, 3, 5), ("art-9-p1", 0, 9, None)], "chunk_id string, part_index int, article int, range_end int"))
    return O.asked_articles(asked, chunks).select("qid", "place", "chunk_id")


def paragraph_markers(spark, d):
    rows = spark.createDataFrame([(1, "(١) أ\n(٢) ب\nج (٣) د"), (2, "نص"), (3, ")١( أ")], "id int, text string")
    return rows.select("id", F.array_join(T.paragraph_numbers(F.col("text")).cast("array<string>"), ",").alias("numbers"), F.size(T.split_paragraphs(F.col("text"))).cast("long").alias("n"))


def opening_connectives(spark, d):
    rows = spark.createDataFrame([(1, "(٢) ومع ذلك يجوز"), (2, "ويجوز"), (3, "يجوز"), (4, "(١) فإذا")], "id int, text string")
    return rows.select("id", T.opening_connective(F.col("text")).alias("word"))


def overlaid_metrics(spark, d):
    rows = spark.createDataFrame([(1, {"a": 1, "b": 2}, {"b": 3, "c": 4}), (2, {}, {"x": 1}), (3, {"y": 1}, {})], "id int, l map<string,int>, r map<string,int>")
    one = O.overlay(F.col("l"), F.col("r"))
    return rows.select("id", F.array_join(F.array_sort(F.transform(F.map_entries(one), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",").alias("merged"))


def cite_expansion(spark, d):
    lists = spark.createDataFrame(LISTS, "qid string, rank int, id string")
    cites = spark.createDataFrame(CITES, "id string, cited array<string>")
    return R.expand_citations(lists, cites, top_k=4).select("qid", "position", "id", "cited_by")


def lookup_priority(spark, d):
    lookup = spark.createDataFrame([("q1", 7, 1), ("q2", 9, 1)], "qid string, id int, rank int")
    note = spark.createDataFrame([("q2", 5, 1)], "qid string, id int, rank int")
    ranked = spark.createDataFrame([("q1", 3, 1), ("q1", 7, 2), ("q2", 4, 1), ("q2", 5, 2)], "qid string, id int, rank int")
    return R.by_priority([lookup, note, ranked]).select("qid", "id", "priority", long("rank"))


def range_lookup(spark, d):
    chunks = spark.createDataFrame([("art-1-p1", 1, None), ("art-3-5", 3, 5)], "chunk_id string, article int, range_end int")
    return R.covered(chunks).select("chunk_id", "number")


def repealed_fallback(spark, d):
    top = spark.createDataFrame([("q1", False, 0.1), ("q2", True, 0.1), ("q3", False, 0.9), ("q4", False, None), ("q5", False, 0.1)], "qid string, is_lookup boolean, rerank double")
    rows = [("q1", 0, 5, 0.4), ("q1", 1, 9, 0.7), ("q1", 2, 11, 0.7), ("q2", 0, 5, 0.9), ("q3", 0, 5, 0.9), ("q4", 0, 5, 0.9), ("q5", 0, 5, 0.2)]
    return R.repealed_fallback(top, spark.createDataFrame(rows, "qid string, idx int, first int, score double"), below=0.3, at_least=0.5)


def citation_check(spark, d):
    rows = spark.createDataFrame([(1, [3, 9, 5], [5, 3]), (2, [], [1]), (3, [7], [])], "id int, cited array<int>, allowed array<int>")
    out = R.split_citations(rows)
    return out.select("id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("given", "hallucinated")])


def params_diff(spark, d):
    kind = "key string, value string"
    return E.params_diff(spark.createDataFrame(BASE_PARAMS, kind), spark.createDataFrame(RUN_PARAMS, kind), derived=["stamp"])


def expected_given(spark, d):
    rows = spark.createDataFrame([(1, [1, 2], [2, 3], "any"), (2, [1, 2], [2, 3], "all"), (3, [1], [1, 2], "all"), (4, [], [1], "all")], "id int, e array<int>, g array<int>, m string")
    return rows.select("id", E.expected_given(F.col("e"), F.col("g"), F.col("m")).alias("ok"))


def trace_filter(spark, d):
    rows = spark.createDataFrame([(1, "False", '["a","b"]'), (2, "true", '["a"]'), (3, "false", "[]"), (4, None, None)], "id int, refused string, contexts string")
    kept = rows.where(~F.coalesce(F.lower("refused") == "true", F.lit(False))).withColumn("c", F.from_json("contexts", "array<string>")).where(F.size("c") > 0)
    return kept.select("id", F.size("c").alias("n_contexts"))


def ci_gate(spark, d):
    kind = "id int, subset string, ci_size int, scored int, faithfulness double, split string, recall double, questions int, base_split string, base_recall double"
    return Q.ci_gate(spark.createDataFrame([g[:10] for g in GATES], kind), min_faithfulness=0.75, max_drop=1).select("id", "faithful_ok", "recall_state", "passed")


def promotion(spark, d):
    rows = spark.createDataFrame([(1, 0.8, 0.7), (2, 0.6, 0.7), (3, None, 0.7), (4, float("nan"), 0.1), (5, 1.5, 0.1), (6, 0.5, None)], "id int, candidate double, production double")
    return rows.select("id", Q.promotion(F.col("candidate"), F.col("production")).alias("promoted"))


def eval_set_checks(spark, d):
    rows = [("q1", "p1", "ar", "a"), ("q2", "p1", "en", "a"), ("q3", "p2", "en", "a"), ("q4", "p2", "en", "a"), ("q5", None, "en", "b"), ("q5", None, "en", "b"), ("q6", "p3", "ar", "a"), ("q7", "p3", "en", "b")]
    return Q.eval_set_problems(spark.createDataFrame(rows, "qid string, pair_id string, language string, kind string"))


TREE = [("root", "a", "Table"), ("a", "b", "TR"), ("a", "c", "TR"), ("c", "d", "TD"), ("d", "e", "P"), ("x", "y", "P")]
PIECES = [(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 20.0, 2.0, 30.0, 11.0), (1, 3, 0.0, 20.0, 5.0, 30.0), (1, 4, 9.0, 28.0, 12.0, 38.0)]


def repeal_replies(spark, d):
    rows = spark.createDataFrame([(1, "en", "waqf", 3, 5, date(1950, 2, 9), "by Law 1"), (2, "en", "waqf", 3, 5, None, None), (3, "ar", "الوقف", 3, 15, date(1950, 2, 9), "بالقانون")], "id int, language string, subject string, first int, last int, day date, law string")
    return rows.select("id", O.repeal_reply(*[F.col(c) for c in ("language", "subject", "first", "last", "day", "law")]).alias("reply"))


def tag_tree(spark, d):
    view = f"tags_{uuid.uuid4().hex}"
    spark.createDataFrame(TREE, "parent string, child string, tag string").createOrReplaceTempView(view)
    return O.tag_counts(spark, view, "root")


def visual_lines(spark, d):
    rows = spark.createDataFrame(PIECES, "cell int, pos int, x0 double, y0 double, x1 double, y1 double")
    return O.visual_lines(rows, rtl=True).select("cell", "pos", long("line_no"), long("place"))


def bold_rows(spark, d):
    spans = [(1, [("x", "Arial-Bold", 0), (" ", "Arial", 0)]), (2, [("x", "Arial", 16), ("y", "Arial", 4)]), (3, [(" ", "Arial", 0)]), (4, [("x", "Arial", 20)])]
    rows = spark.createDataFrame(spans, "id int, spans array<struct<text:string,font:string,flags:int>>")
    return rows.select("id", O.all_bold(F.col("spans")).alias("bold"))


LINES = [(1, i, x) for i, x in enumerate(["intro", "CHAPTER one", "a", "b", "CHAPTER two", "c", "END", "junk"])]
SPLIT = [("q001", None, "a", "english", "tuning"), ("q002", None, "a", "msa", "heldout"), ("q003", "p1", "b", "english", "tuning"), ("q004", "p1", "b", "msa", "tuning"), ("q005", None, "b", "msa", "heldout"), ("q006", None, "c", "english", "heldout")]


def balanced_split(spark, d):
    rows = spark.createDataFrame([x[:4] for x in SPLIT], "qid string, pair_id string, kind string, register string")
    return E.balanced_split(rows)


def glyph_repair(spark, d):
    lam_alef = [{"c": "ا", "x0": 5.0, "x1": 5.0}, {"c": "ل", "x0": 5.0, "x1": 9.0}]
    digits = [{"c": "٢", "x0": 9.0, "x1": 12.0}, {"c": "١", "x0": 5.0, "x1": 8.0}]
    space = [{"c": " ", "x0": 1.0, "x1": 2.0}, {"c": "ب", "x0": 6.0, "x1": 8.0}, {"c": "ت", "x0": 0.0, "x1": 1.0}]
    rows = spark.createDataFrame([(1, lam_alef), (2, digits), (3, space)], f"id long, piece {glyphs.GLYPHS}")
    return rows.select("id", glyphs.repair_glyphs("piece").alias("text"))


def cut_sections(spark, d):
    rows = spark.createDataFrame(LINES, "doc long, line_no int, line string")
    return O.cut_sections(rows, [("one", "^CHAPTER one"), ("two", "^CHAPTER"), (None, "^END")])


HEADING_CELLS = [
    (1, "PART I\nGeneral\n1. Scope", "القسم الأول\nعام\n١- نطاق", "PART I General=القسم الأول عام|1. Scope=١- نطاق", True),
    (2, "Only", "", "Only=-", True),
    (3, "CHAPTER II", "الباب الثاني", "CHAPTER II=الباب الثاني", True),
    (4, "1- The Relationship between the Surety and the\nCreditor", "١ -العلاقة ما بين الكفيل والدائن", "1- The Relationship between the Surety and the Creditor=١ -العلاقة ما بين الكفيل والدائن", True),
    (5, "1. Elements of Contracts\nConsent:", "أولاً- أركان العقد\n١ -الرضاء", "1. Elements of Contracts=أولاً- أركان العقد|Consent:=١ -الرضاء", True),
    (6, "1. One\n2. Two", "واحد", "1. One=واحد|2. Two=-", False),
    (7, "", "موت المستأجر أو إعساره", "-=موت المستأجر أو إعساره", True),
]


def heading_units(spark, d):
    rows = spark.createDataFrame([c[:3] for c in HEADING_CELLS], "id int, en string, ar string")
    cell = H.aligned(H.units(H.cell_lines(F.col("en")), "en"), H.units(H.cell_lines(F.col("ar")), "ar"))
    name = lambda u: F.coalesce(u["text"], F.lit("-"))
    return rows.select("id", cell.alias("c")).select("id", F.array_join(F.transform("c.pairs", lambda p: F.concat(name(p["en"]), F.lit("="), name(p["ar"]))), "|").alias("units"), "c.aligned")


def highlighted_passages(spark, d):
    rows = spark.createDataFrame([(1, ["a one", "b two", "c", "d one"], ["one", "two", "one", "zzz"]), (2, ["x"], []), (3, [], ["q"])], "id int, lines array<string>, fragments array<string>")
    return O.highlighted_passages(rows).select("id", F.array_join("passages", "|").alias("passages"), F.array_join("leftover", "|").alias("leftover"))


ORACLES = {
    "light_stem": f"SELECT * FROM {values_sql(STEMS, 'word, stem')}",
    "normalize_unicode": f"SELECT id::BIGINT AS id, clean FROM {values_sql([(i, c) for i, _, c in UNICODE], 'id, clean')}",
    "fold_arabic": f"SELECT id::BIGINT AS id, folded FROM {values_sql([(i, c) for i, _, c in FOLDS], 'id, folded')}",
    "article_references": f"SELECT id::BIGINT AS id, numbers FROM {NUMBERS_LIST(REFERENCES)}",
    "cited_articles": f"SELECT id::BIGINT AS id, numbers FROM {NUMBERS_LIST(CITED)}",
    "question_language": f"SELECT id::BIGINT AS id, language FROM {values_sql([(i, x) for i, _, x in LANGUAGES], 'id, language')}",
    "cer_near_copies": f"SELECT sum(levenshtein(got, gold))::BIGINT AS edits, sum(length(gold))::BIGINT AS gold_chars, round(sum(levenshtein(got, gold))::DOUBLE / sum(length(gold)), 6) AS cer FROM {values_sql(CER, 'id, got, gold')}",
    "pii_redact": f"SELECT id::BIGINT AS id, shown FROM {values_sql([(i, x) for i, _, x in PII], 'id, shown')}",
    "classify_rows": f"SELECT page, row_index, kind FROM {values_sql([(r[0], r[1], r[6]) for r in ROWS], 'page, row_index, kind')}",
    "heading_paths": f"SELECT pos, path FROM {values_sql([(r[0], ' > '.join(r[3])) for r in PATHS], 'pos, path')}",
    "assemble_articles": "SELECT article_number, n_en::BIGINT AS n_en, path, pages::BIGINT AS pages, is_repealed FROM "
    + values_sql([(1, 20, "PART I General", 1, False), (2, 27, "PART I General > 1. Scope", 2, False), *[(n, 28, "PART I General > 1. Scope", 1, True) for n in (3, 4, 5)]], "article_number, n_en, path, pages, is_repealed"),
    "assembly_anomalies": "SELECT * FROM " + values_sql([(2, 2, "unclassified"), (1, 0, "untitled_heading")], "page, row_index, anomaly"),
    "repealed_ranges": "SELECT article_number, range_end, citation, n::BIGINT AS n FROM " + values_sql([(1, None, None, 1), (2, None, None, 1), (3, 5, "Articles 3-5 | المواد من ٣ إلى ٥", 3)], "article_number, range_end, citation, n"),
    "repair_rows": "SELECT page, row_index, en_text, ar_text, header_split, markers_fixed::BIGINT AS markers_fixed FROM "
    + values_sql([(1, 1, "Article 1\nFirst text", "مادة ١\nنص", False, 0), (1, 3, "Article 2\nSame line", "مادة ٢\n(١) أ", True, 0), (2, 1, ROWS[5][2], ROWS[5][3], False, 0)], "page, row_index, en_text, ar_text, header_split, markers_fixed"),
    "errata": "SELECT page, row_index, en_text FROM " + values_sql([(r[0], r[1], r[2].replace("First text", "Better text")) for r in ROWS if r[1] < 2], "page, row_index, en_text"),
    "clean_questions": f"SELECT id, clean FROM {values_sql([(q[0], q[3]) for q in QUESTIONS], 'id, clean')}",
    "run_identities": f"SELECT id, name FROM {values_sql([(r[0], r[6]) for r in RUNS], 'id, name')}",
    "delivery_scope": f"SELECT deliver, id FROM {values_sql([(False, 1), (True, 2), (True, 3), (True, 4)], 'deliver, id')}",
    "nested_ranks": f"SELECT * FROM {values_sql([(1, '3,4,5,6'), (2, '1'), (3, '')], 'id, nested')}",
    "heading_spans": 'SELECT path, "first", "last", n::BIGINT AS n FROM ' + values_sql([("PART I General", 1, 1, 1), ("PART I General > 1. Scope", 2, 5, 4)], 'path, "first", "last", n'),
    "row_classes": "SELECT kind, n::BIGINT AS n FROM " + values_sql([("heading", 2), ("article", 2), ("continuation", 1), ("repeal", 1), ("anomaly", 1)], "kind, n"),
    "corpus_checks": "SELECT check_id, n::BIGINT AS n FROM " + values_sql([("markers", 1), ("header_inside", 1), ("empty", 1)], "check_id, n"),
    "asked_articles": f"SELECT * FROM {values_sql([('q1', 0, 'art-3-5'), ('q1', 1, 'art-3-5')], 'qid, place, chunk_id')}",
    "paragraph_markers": "SELECT id, numbers, n::BIGINT AS n FROM " + values_sql([(1, "1,2", 2), (2, "", 1), (3, "1", 1)], "id, numbers, n"),
    "opening_connectives": f"SELECT * FROM {values_sql([(1, 'ومع ذلك'), (2, 'ويجوز'), (3, ''), (4, 'فإذا')], 'id, word')}",
    "overlaid_metrics": f"SELECT * FROM {values_sql([(1, 'a=1,b=3,c=4'), (2, 'x=1'), (3, 'y=1')], 'id, merged')}",
    "cite_expansion": f"SELECT * FROM {values_sql(EXPANDED, 'qid, position, id, cited_by')}",
    "lookup_priority": f"SELECT qid, id, priority, rank::BIGINT AS rank FROM {values_sql([('q1', 7, 0, 1), ('q1', 3, 2, 2), ('q2', 9, 0, 1), ('q2', 5, 1, 2), ('q2', 4, 2, 3)], 'qid, id, priority, rank')}",
    "range_lookup": f"SELECT * FROM {values_sql([('art-1-p1', 1), ('art-3-5', 3), ('art-3-5', 4), ('art-3-5', 5)], 'chunk_id, number')}",
    "repealed_fallback": "SELECT 'q1' AS qid, 9 AS first, 0.7::DOUBLE AS passage_score",
    "citation_check": f"SELECT * FROM {values_sql([(1, '3,5', '9'), (2, '', ''), (3, '', '7')], 'id, given, hallucinated')}",
    "params_diff": f"SELECT key, base, run, change FROM {values_sql([('k', '60', '10', 'changed'), ('old', '1', None, 'removed'), ('new', None, '2', 'added')], 'key, base, run, change')}",
    "expected_given": f"SELECT * FROM {values_sql([(1, True), (2, False), (3, True), (4, False)], 'id, ok')}",
    "trace_filter": "SELECT 1 AS id, 2 AS n_contexts",
    "ci_gate": f"SELECT * FROM {values_sql([(g[0], *g[10:]) for g in GATES], 'id, faithful_ok, recall_state, passed')}",
    "promotion": f"SELECT * FROM {values_sql([(1, True), (2, False), (3, False), (4, False), (5, False), (6, True)], 'id, promoted')}",
    "eval_set_checks": f"SELECT * FROM {values_sql([('q5', 'duplicate id'), ('p2', 'bad pair'), ('p3', 'bad pair')], 'key, problem')}",
    "repeal_replies": "SELECT * FROM "
    + values_sql(
        [
            (1, "The Civil Code's provisions on waqf were in Articles 3-5. They were repealed as of 9 February 1950 by Law 1. The current Code keeps only a note that these articles are repealed."),
            (2, "The Civil Code's provisions on waqf were in Articles 3-5. They were repealed. The current Code keeps only a note that these articles are repealed."),
            (3, "كانت أحكام الوقف في القانون المدني واردة في المواد من ٣ إلى ١٥، وقد ألغيت اعتبارًا من ٩ فبراير ١٩٥٠ بالقانون. ولا يتضمن القانون المدني الحالي من هذه المواد إلا ما يفيد إلغاءها."),
        ],
        "id, reply",
    ),
    "tag_tree": "SELECT tag, n::BIGINT AS n, depth FROM " + values_sql([("Table", 1, 1), ("TR", 2, 2), ("TD", 1, 3), ("P", 1, 4)], "tag, n, depth"),
    "visual_lines": "SELECT cell, pos, line_no::BIGINT AS line_no, place::BIGINT AS place FROM " + values_sql([(1, 1, 1, 2), (1, 2, 1, 1), (1, 3, 2, 1), (1, 4, 3, 1)], "cell, pos, line_no, place"),
    "bold_rows": f"SELECT * FROM {values_sql([(1, True), (2, False), (3, None), (4, True)], 'id, bold')}",
}
ORACLES |= {
    "balanced_split": f"SELECT qid, half FROM {values_sql([(x[0], x[4]) for x in SPLIT], 'qid, half')}",
    "glyph_repair": "SELECT id::BIGINT AS id, text FROM " + values_sql([(1, "لا"), (2, "١٢"), (3, "ب ت")], "id, text"),
    "cut_sections": "SELECT doc::BIGINT AS doc, section, text FROM " + values_sql([(1, "one", "a\nb"), (1, "two", "c")], "doc, section, text"),
    "heading_units": f"SELECT * FROM {values_sql([(c[0], c[3], c[4]) for c in HEADING_CELLS], 'id, units, aligned')}",
    "highlighted_passages": "SELECT * FROM " + values_sql([(1, "one\ntwo|one", "zzz"), (2, "", ""), (3, "", "q")], "id, passages, leftover"),
}
CASES = {name: globals()[name] for name in ORACLES}
