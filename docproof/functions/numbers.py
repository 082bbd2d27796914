"""Amounts: reading numbers out of text and finding them again in it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docproof import constants as C
from docproof.functions.text import py_strip

AMOUNT_RUN = rf"[\p{{Nd}}{C.PY_SPACES}.,{C.ARABIC_DECIMAL_SEPARATOR}]+"
LINE_ENDS = "\n\r"
AMOUNT_RUN_ONE_LINE = AMOUNT_RUN.replace("\n", "").replace("\r", "")


def _ascii_number(text: Column, keep: str = "") -> Column:
    """All Unicode digits to ASCII, Arabic decimal sign to a point, whitespace (but for ``keep``) removed."""
    # ``translate`` deletes the characters that have no partner, here the whitespace.
    spaces = "".join(c for c in C.PY_SPACES if c not in keep)
    return F.translate(
        text,
        C.DECIMAL_DIGITS_FROM + C.ARABIC_DECIMAL_SEPARATOR + spaces,
        C.DECIMAL_DIGITS_TO + ".",
    )


def _resolve_separators(s: Column) -> Column:
    """Leave one kind of separator: the point as decimal sign."""
    last_dot = F.locate(".", F.reverse(s))
    last_comma = F.locate(",", F.reverse(s))
    no_commas = F.replace(s, F.lit(","), F.lit(""))
    comma_as_point = F.replace(s, F.lit(","), F.lit("."))
    return (
        F.when(~F.contains(s, F.lit(",")), s)
        .when(
            last_dot > 0,
            F.when(last_dot > last_comma, F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
            .otherwise(no_commas),
        )
        .when(F.rlike(s, F.lit(r",[0-9]{1,2}$")), comma_as_point)
        .otherwise(no_commas)
    )


def normalize_number_str(text: Column) -> Column:
    return _resolve_separators(_ascii_number(text))


def _to_double(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9.\-]", "").try_cast("double")


def normalize_number(text: Column) -> Column:
    """Text to double with thousands and decimal signs resolved; null when no number remains."""
    return _to_double(normalize_number_str(text))


def parse_float_amount(text: Column) -> Column:
    """Stricter reader: drops blanks, ASCII letters, currency signs and commas, then needs a plain number."""
    s = F.translate(py_strip(text), " $€£,", "")
    s = F.translate(F.regexp_replace(s, "[A-Za-z]+", ""), C.DECIMAL_DIGITS_FROM, C.DECIMAL_DIGITS_TO)
    return py_strip(s).try_cast("double")


def amount_candidates(text: Column, strict: bool = False) -> Column:
    """Every run of digits, blanks and separators. Runs may span lines unless ``strict``."""
    return F.regexp_extract_all(text, F.lit(AMOUNT_RUN_ONE_LINE if strict else AMOUNT_RUN), F.lit(0))


def plain_amounts(text: Column, strict: bool = False) -> Column:
    """The text with ASCII digits and without blanks.

    Blanks belong to every run they touch and are dropped when a run is read, so they can go first: the runs left are the
    same amounts, found with a plain character class.
    """
    return _ascii_number(text, keep=LINE_ENDS if strict else "")


def text_amounts(text: Column, strict: bool = False) -> Column:
    """The amounts printed in a text, rounded to two decimals."""
    # Whole runs with a digit; the look behind keeps long runs of separators from being tried at each place.
    runs = F.regexp_extract_all(plain_amounts(text, strict), F.lit("(?<![0-9.,])[.,]*+[0-9][0-9.,]*"), F.lit(0))
    # Without their separators they hold digits and points only.
    values = F.transform(F.array_distinct(runs), lambda r: F.round(_resolve_separators(r).try_cast("double"), 2))
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull()))


def amount_in(value: Column, amounts: Column) -> Column:
    target = F.round(value, 2)
    return F.coalesce(F.exists(amounts, lambda a: F.abs(a - target) < C.AMOUNT_TOLERANCE), F.lit(False))


def amount_grounded(value: Column, text: Column, strict: bool = False) -> Column:
    """Is the amount printed in the text?"""
    return amount_in(value, text_amounts(text, strict))


def number_text(value: Column) -> Column:
    """Shortest decimal text of a double without an exponent, ``1180.0`` for whole numbers."""
    plain = value.cast("decimal(38,10)").cast("string")
    trimmed = F.regexp_replace(plain, "0+$", "")
    long_form = F.when(F.endswith(trimmed, F.lit(".")), F.concat(trimmed, F.lit("0"))).otherwise(trimmed)
    return F.when((F.abs(value) >= 1e7) & (F.abs(value) < 1e16), long_form).otherwise(value.cast("string"))
