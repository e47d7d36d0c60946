"""Text functions as Column expressions: they stay in the JVM, inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: they must equal the reference's for equal results. ----
# Tatweel, zero-width and bidirectional control characters.
INVISIBLE = "[\\u0640\\u200b-\\u200f\\u202a-\\u202e\\u2066-\\u2069\\u061c\\ufeff]"
# Whitespace but for the line break, as Python's str.isspace has it.
INLINE_SPACE = "[\\t\\u000b\\f\\r\\u001c-\\u001f \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
DIACRITICS = "[\\u064b-\\u0652\\u0670]"
ALEF_FROM, ALEF_TO = "أإآٱىة", "اااايه"
ARABIC_DIGITS, PERSIAN_DIGITS, ASCII_DIGITS = "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹", "0123456789"
LUCENE_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that",
    "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)
NLTK_STOPWORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've", "you'll", "you'd", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "she's", "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them", "their",
    "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "that'll", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as",
    "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after", "above",
    "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same",
    "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "don't", "should", "should've", "now", "d", "ll", "m", "o", "re", "ve", "y",
    "ain", "aren", "aren't", "couldn", "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't",
    "isn", "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't", "shouldn", "shouldn't", "wasn", "wasn't",
    "weren", "weren't", "won", "won't", "wouldn", "wouldn't",
)
STOPWORDS = {"none": [], "lucene": list(LUCENE_STOPWORDS), "nltk": list(NLTK_STOPWORDS)}
MARKER_BODY = r"[()]\s*[١-٩][٠-٩]*\s*[().]?\s*[()]"
CONNECTIVES = ("ومع ذلك", "ومع هذا", "غير أن", "إلا أن", "على أن", "ولكن", "فإذا", "وإذا", "فإن", "وفي هذه الحالة", "وفى هذه الحالة", "ويجوز", "ولا يجوز")
REFUSAL = (
    r"(?iu)(do(es)? not (address|provide|directly address|specify)|not directly addressed|"
    "لا تتناول|لا يتناول|لا يوجد في المقالات|لا تتضمن|لا تجيب)"
)
MIN_ANSWER_CHARS = 40
# Words that a number follows when articles are cited, folded: one, several, two, from and to.
ARABIC_PREFIX = "(?<![\\p{L}\\p{N}_])[وف]?(?:ال|بال|لل)?"
CITED_ONE = ARABIC_PREFIX + r"ماده\s*\(?\s*[0-9]+", r"(?i:(?<![\p{L}\p{N}_])(?:article|art\.?)\s*\(?\s*[0-9]+)"
NUMBER_LIST = r"[0-9]+(?:\s*(?:,|،|and|or|to|و|-|–)\s*[0-9]+)*"
CITED_MANY = r"(?i:(?<![\p{L}\p{N}_])articles\s+" + NUMBER_LIST + ")", ARABIC_PREFIX + r"مادت(?:ين|ان)\s*" + NUMBER_LIST
CITED_RANGE = ARABIC_PREFIX + r"مواد\s*من\s*[0-9]+(?:\s*(?:الي|حتي)\s*[0-9]+)?"
# ---- End of fixed values. ----


#: Before a class of characters above U+0600, or of blanks: one comparison passes over the characters of most texts.
ABOVE_LATIN, NOT_INK = "(?![\\x00-\\u0600])", "(?![!-~])"
#: What folding changes; most texts of other alphabets have none of it.
FOLDED = ABOVE_LATIN + "[\\u0640\\u200b-\\u200f\\u202a-\\u202e\\u2066-\\u2069\\u061c\\ufeff\\u064b-\\u0652\\u0670" + ALEF_FROM + ARABIC_DIGITS + PERSIAN_DIGITS + "]"


def normalize_lines(text: Column) -> Column:
    """Invisible characters dropped, inline whitespace collapsed, lines stripped, empty lines dropped (rules N3 to N5).

    Plain regular expressions: splitting into an array of lines would leave whole-stage code generation. Single spaces,
    which stay, are no match.
    """
    spaces = f"{NOT_INK}(?: (?={INLINE_SPACE})|(?! ){INLINE_SPACE}){INLINE_SPACE}*"
    clean = F.regexp_replace(F.regexp_replace(text, ABOVE_LATIN + INVISIBLE, ""), spaces, " ")
    return F.btrim(F.regexp_replace(clean, " ?\n[\n ]*", "\n"), F.lit(" \n"))


def fold_letters(text: Column) -> Column:
    """Letter variants unified, diacritics and invisible characters dropped, digits in ASCII; texts without any go through untouched."""
    plain = F.translate(F.regexp_replace(text, ABOVE_LATIN + INVISIBLE, ""), ALEF_FROM + ARABIC_DIGITS + PERSIAN_DIGITS, ALEF_TO + ASCII_DIGITS * 2)
    return F.when(text.rlike(FOLDED), F.regexp_replace(plain, DIACRITICS, "")).otherwise(text)


def fold(text: Column) -> Column:
    """Matching key: normalised lines, folded (F1 to F5)."""
    return fold_letters(normalize_lines(text))


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the folded, lower-cased text; underscores separate. White space needs no cleaning for this."""
    return F.regexp_extract_all(F.lower(fold_letters(text)), F.lit(r"[\p{L}\p{N}]++"), F.lit(0))


def light_stem(token: Column) -> Column:
    """Drops a leading conjunction from four letters on, then one article if two letters remain."""
    bare = F.when((F.length(token) >= 4) & F.substring(token, 1, 1).isin("و", "ف"), F.substr(token, F.lit(2))).otherwise(token)
    return (
        F.when(bare.startswith("بال") & (F.length(bare) >= 5), F.substr(bare, F.lit(4)))
        .when(bare.startswith("ال") & (F.length(bare) >= 4), F.substr(bare, F.lit(3)))
        .otherwise(bare)
    )


def without_stopwords(words: Column, which: str) -> Column:
    """Keeps repeats, unlike array_except."""
    if which not in STOPWORDS:
        raise ValueError(f"no stopword list {which}")
    drop = STOPWORDS[which]
    return F.filter(words, lambda w: ~w.isin(drop)) if drop else words


def search_tokens(text: Column, *, tokenizer: str = "words", stopwords: str = "none") -> Column:
    """The tokenizer registry: ``words`` or ``words_light_stem``."""
    if tokenizer not in ("words", "words_light_stem"):
        raise ValueError(f"no tokenizer {tokenizer}")
    found = tokens(text)
    if tokenizer == "words_light_stem":
        found = F.transform(found, light_stem)
    return without_stopwords(found, stopwords)


def arabic_digits(number: Column) -> Column:
    return F.translate(number.cast("string"), ASCII_DIGITS, ARABIC_DIGITS)


def ascii_digits(text: Column) -> Column:
    """One character for one, so offsets hold."""
    return F.translate(text, ARABIC_DIGITS + PERSIAN_DIGITS, ASCII_DIGITS * 2)


def citation(number: Column) -> Column:
    return F.concat(F.lit("Article "), number.cast("string"), F.lit(" | المادة "), arabic_digits(number))


def range_citation(first: Column, last: Column) -> Column:
    return F.concat(
        F.lit("Articles "), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(" | المواد من "), arabic_digits(first), F.lit(" إلى "), arabic_digits(last)
    )


def heading_label(path: Column) -> Column:
    return F.array_join(F.filter(path, lambda x: x != ""), " > ")


def document_text(text_ar: Column, text_en: Column, path_ar: Column, path_en: Column, *, variant: str = "both_with_headings") -> Column:
    """What is indexed of a chunk; empty parts leave no line."""
    parts = {
        "both_with_headings": [heading_label(path_ar), text_ar, heading_label(path_en), text_en],
        "ar_only": [heading_label(path_ar), text_ar],
        "both_without_headings": [text_ar, text_en],
    }
    if variant not in parts:
        raise ValueError(f"no document text variant {variant}")
    return F.concat_ws("\n", *[F.nullif(p, F.lit("")) for p in parts[variant]])


def split_paragraphs(text: Column, opener: str = MARKER_BODY) -> Column:
    """Pieces that begin at lines opening with a marker; blank pieces are dropped."""
    return F.filter(F.split(text, rf"\n(?={opener})", -1), lambda p: F.trim(F.regexp_replace(p, r"\s", "")) != "")


def paragraph_numbers(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?m)^[()]\s*([١-٩][٠-٩]*)\s*[().]?\s*[()]"), F.lit(1))
    return F.transform(found, lambda n: ascii_digits(n).cast("int"))


def pack(pieces: Column, max_chars: int) -> Column:
    """Neighbouring pieces joined by nothing up to max_chars; a longer piece stays whole."""
    kind = "struct<now:string,done:array<string>>"
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("done")).cast(kind)

    def step(acc: Column, piece: Column) -> Column:
        fits = (acc["now"] == "") | (F.length(acc["now"]) + F.length(piece) <= max_chars)
        return F.struct(
            F.when(fits, F.concat(acc["now"], piece)).otherwise(piece).alias("now"),
            F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))).alias("done"),
        ).cast(kind)

    return F.aggregate(pieces, start, step, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


def opening_connective(text: Column) -> Column:
    """The connective that a paragraph opens with after its marker, else empty."""
    bare = F.regexp_replace(text, r"^[()\s]*[١-٩][٠-٩]*\s*[().]?\s*[()]\s*،?\s*", "")
    return F.regexp_extract(bare, "^(" + "|".join(CONNECTIVES) + ")", 1)


def question_language(text: Column) -> Column:
    """``ar`` if there are Arabic words and at least as many as Latin ones, else ``en``."""
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}\p{M}_]+"), F.lit(0))
    arabic = F.size(F.filter(words, lambda w: w.rlike("[ء-ي]")))
    latin = F.size(F.filter(words, lambda w: w.rlike("[A-Za-z]")))
    return F.when((arabic > 0) & (arabic >= latin), "ar").otherwise("en")


def answer_kind(answer: Column, unaddressed: Column) -> Column:
    text = F.trim(answer)
    first = F.element_at(F.split(text, r"(?<=[.!?؟])\s|\n", 2), 1)
    return F.when(unaddressed, "gate").when(first.rlike(REFUSAL) | (F.length(text) < MIN_ANSWER_CHARS), "refusal").otherwise("answer")


def article_references(question: Column) -> Column:
    """Article numbers that a question names, in order, each once; plurals are left to search."""
    pattern = r"(?=[aAوفابلم])(?iu)(?:(?=[وفابلم])(?<![\p{L}\p{N}_])[وف]?(?:ال|بال|لل)?ماده|(?=art)(?<![\p{L}\p{N}_])(?:article|art\.?))\s*\(?\s*\d+"
    found = F.regexp_extract_all(fold(question), F.lit(pattern), F.lit(0))
    return F.array_distinct(F.transform(found, lambda m: F.regexp_extract(m, r"(\d+)$", 1).cast("int")))


def cited_articles(folded: Column) -> Column:
    """Article numbers that a folded text cites, by place, each once: single, listed, dual, and both ends of ranges.

    The forms exclude each other, so one pass over their alternation finds all; whatever digits a match has are numbers.
    """
    found = F.regexp_extract_all(folded, F.lit("|".join([*CITED_MANY, CITED_RANGE, *CITED_ONE])), F.lit(0))
    numbers = F.flatten(F.transform(found, lambda m: F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))))
    return F.array_distinct(F.array_compact(F.transform(numbers, lambda n: n.try_cast("long"))))


def character_shares(text: Column) -> dict[str, Column]:
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return {
        "n_presentation": F.regexp_count(text, F.lit("[\\ufb50-\\ufdff\\ufe70-\\ufeff]")),
        "n_control": F.regexp_count(text, F.lit(r"[\p{Cc}\p{Cf}&&[^\n]]")),
        "n_private": F.regexp_count(text, F.lit(r"\p{Co}")),
        "latin_share": F.coalesce(F.try_divide(F.regexp_count(text, F.lit("[A-Za-z]")), letters), F.lit(0.0)),
    }


def windows(text: Column, size: int) -> Column:
    """Slices of so many code points, in order; one blank slice for an empty text."""
    n = F.greatest(F.length(text) - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), n, F.lit(size)), lambda i: F.substr(text, i + 1, F.lit(size)))
