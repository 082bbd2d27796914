"""Text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docproof import constants as C

NON_ALNUM = r"[^\p{L}\p{N}]+"
LINE_BREAK = f"\r\n|[{C.LINE_BREAKS}]"
BLANK_RUN = f"[{C.LINE_BLANKS}]+"


def py_strip(text: Column) -> Column:
    """Trim Unicode whitespace on both sides."""
    return F.btrim(text, F.lit(C.PY_SPACES))


def strip_column(name: str) -> Column:
    """``py_strip`` of a column at hand, which may be looked at several times.

    Trimming walks the whole text, which most texts are spared: letters between ``!`` and ``~`` and from U+00C0 to U+0FFF
    are no white space.
    """
    text = F.col(name)
    letter = lambda c: c.between("!", "~") | c.between("\u00c0", "\u0fff")
    plain = letter(F.substring(text, 1, 1)) & letter(F.substring(text, -1, 1))
    return F.when(plain, text).otherwise(py_strip(text))


def fold_digits(text: Column, strict: bool = False) -> Column:
    """Arabic-Indic and Persian digits to ASCII."""
    if strict:
        return F.translate(text, C.STRICT_DIGITS_FROM, C.STRICT_DIGITS_TO)
    return F.translate(text, C.FOLD_DIGITS_FROM, C.FOLD_DIGITS_TO)


def fold_text(text: Column, strict: bool = False) -> Column:
    """Comparison form: lower case, ASCII digits, letters and numbers only."""
    return F.regexp_replace(fold_digits(F.lower(F.coalesce(text, F.lit(""))), strict), NON_ALNUM, "")


def is_empty_value(text: Column) -> Column:
    return F.coalesce(py_strip(text), F.lit("")).isin(*C.EMPTY_WORDS)


def safe_basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def file_suffix(name: Column) -> Column:
    """Last extension of a file name with its dot, empty for dot files and names without one."""
    return F.regexp_extract(name, r"^.*[^.].*?(\.[^./]+)$", 1)


def file_stem(name: Column) -> Column:
    return F.substr(name, F.lit(1), F.length(name) - F.length(file_suffix(name)))


def initials(name: Column) -> Column:
    """First letters of the first two words, ``U`` when there is no word."""
    words = F.filter(F.split(F.coalesce(name, F.lit("")), f"[{C.PY_SPACES}]+"), lambda w: w != "")
    first, second = (F.upper(F.left(F.get(words, F.lit(i)), F.lit(1))) for i in (0, 1))
    return F.coalesce(F.concat(first, F.coalesce(second, F.lit(""))), F.lit("U"))


def status_slug(status: Column) -> Column:
    return F.replace(F.lower(status), F.lit(" "), F.lit("_"))


# --- document text ----------------------------------------------------------------------------------------


def has_html(text: Column) -> Column:
    return F.coalesce(F.contains(text, F.lit(">")) & F.rlike(text, F.lit(C.HTML_TAG)), F.lit(False))


def split_lines(text: Column) -> Column:
    """Lines as Python's ``splitlines`` cuts them, without the empty piece after a final break."""
    return F.split(F.regexp_replace(text, f"(?:{LINE_BREAK})\\z", ""), LINE_BREAK)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def drop_repeated_lines(lines: Column) -> Column:
    """Drop an element equal to the one before it."""
    return let(lines, lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1))))


def clean_ocr(text: Column) -> Column:
    """Collapse blanks inside lines, drop adjacent repeats, trim."""
    # No blank character is a line break, so blanks may be collapsed on the whole text before it is cut.
    lines = F.transform(split_lines(F.regexp_replace(text, BLANK_RUN, " ")), py_strip)
    return F.coalesce(py_strip(F.array_join(drop_repeated_lines(lines), "\n")), F.lit(""))


def compress_table(text: Column, total_lines: Column) -> Column:
    """Keep the first lines of a product table and say how many rows were left out."""
    lines = split_lines(text)
    kept = F.least(F.size(lines), F.lit(C.TABLE_LINES_KEPT))
    lower = F.lower(text)
    has_table = F.lit(False)
    for word in minimal_words(C.TABLE_WORDS):
        has_table = has_table | F.contains(lower, F.lit(word))
    removed = F.greatest(F.lit(1), total_lines.cast("int") - kept)
    note = F.concat(F.lit("\n[PRODUCT TABLE REMOVED - "), removed.cast("string"), F.lit(" ROWS]"))
    return F.when(
        has_table, F.concat(F.array_join(F.slice(lines, 1, C.TABLE_LINES_KEPT), "\n"), note)
    ).otherwise(text)


def minimal_words(words: tuple[str, ...]) -> list[str]:
    """The words that contain no other word of the list: enough for an any-of substring test."""
    return [w for w in dict.fromkeys(words) if not any(v != w and v in w for v in words)]
