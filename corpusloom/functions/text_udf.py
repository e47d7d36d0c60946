"""What the built-in functions cannot express: Unicode normal forms. Arrow-batched pandas UDFs."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions import text as T

PRESENTATION = re.compile("[\\ufb50-\\ufdff\\ufe70-\\ufeff]+")
INVISIBLE = re.compile(T.INVISIBLE)
DIACRITICS = re.compile(T.DIACRITICS)
FOLDS = str.maketrans(T.ALEF_FROM + T.ARABIC_DIGITS + T.PERSIAN_DIGITS, T.ALEF_TO + T.ASCII_DIGITS * 2)


def normalize(text: str) -> str:
    """Rules N1 to N5: presentation forms to NFKC, all to NFC, invisible characters dropped, lines cleaned."""
    if not text.isascii():
        shown = PRESENTATION.sub(lambda m: unicodedata.normalize("NFKC", m[0]), INVISIBLE.sub("", text))
        text = INVISIBLE.sub("", unicodedata.normalize("NFC", shown))
    return "\n".join(clean for line in text.split("\n") if (clean := " ".join(line.split())))


def fold(text: str) -> str:
    return DIACRITICS.sub("", normalize(text).translate(FOLDS))


@F.pandas_udf(StringType())
def normalize_unicode(texts: pd.Series) -> pd.Series:
    return texts.map(normalize, na_action="ignore")


@F.pandas_udf(StringType())
def fold_unicode(texts: pd.Series) -> pd.Series:
    return texts.map(fold, na_action="ignore")
