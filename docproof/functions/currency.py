"""Currency names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docproof import constants as C
from docproof.functions.text import minimal_words, py_strip


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in minimal_words(words):
        found = found | F.contains(text, F.lit(word))
    return found


def normalize_currency(value: Column) -> Column:
    """Every spelling of the Saudi riyal becomes ``SAR``; other names are only trimmed."""
    text = py_strip(F.coalesce(value, F.lit("")))
    return F.when(contains_any(F.lower(text), C.RIYAL_MARKS), F.lit("SAR")).otherwise(text)


def currency_code(value: Column) -> Column:
    """A known three-letter code named in the text, null when there is none."""
    upper = F.upper(value)
    code = F.nullif(
        F.regexp_extract(upper, r"(?:^|[^\p{L}\p{N}])(" + "|".join(C.CURRENCY_CODES) + r")(?:$|[^\p{L}\p{N}])", 1),
        F.lit(""),
    )
    return F.coalesce(code, F.when(contains_any(F.lower(value), C.RIYAL_NAMES), F.lit("SAR")))
