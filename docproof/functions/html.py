"""Text of HTML pages as column expressions: cut into tokens by one pattern, turn each token into text, join.

Character references are decoded in text only. A tag that forms a block becomes a mark, and marks become line breaks
where the text before them does not end in one. Markup that no token fits is text, so no page can fail a task.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from docproof import constants as C
from docproof.functions.text import has_html, let, py_strip

MARK = ""  # stands for the border of a block; a private character, taken out of the source first
ATTRIBUTES = r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+"
RAW = rf"<(?:script|style)(?=[\s/>]){ATTRIBUTES}(?<!/)>"
RAW_END = r"</(?:script|style)(?=[\s/>])[^>]*+(?:>|\z)"
KNOWN_SECTION = r"<!\[(?:(?:temp|cdata|ignore|include|rcdata)\b.*?\]\s*\]|(?:if|else|endif)\b.*?\])\s*>"
TOKENS = "|".join(
    (
        r"<!--.*?(?:--!?>|\z)",
        KNOWN_SECTION,
        r"<!\[",  # a section of any other kind
        r"<[!?][^>]*+(?:>|\z)",
        *(rf"{RAW}.*?{RAW_END}".replace("(?:script|style)", name) for name in ("script", "style")),
        rf"{RAW}.*+\z",  # never closed: held back
        rf"<[a-z]{ATTRIBUTES}(?:>|\z)",
        r"</[^>]*+(?:>|\z)",
        r"<\z",
        r"[^<]++",
        r"<",
    )
)
FLAGS = "(?si)"
REFERENCE = r"&(?:#[0-9]++;?|#x[0-9a-f]++;?|[^\t\n\f <&#;]{1,32};?)"
# An unfinished reference in the last 34 characters keeps the text after the last tag back.
UNFINISHED = r"&[^&\t\n\r\f ;]{0,33}\z"


def _names() -> Column:
    return F.from_json(F.lit(json.dumps(html5)), "map<string,string>")


def _short_names() -> str:
    """Names that also count without a semicolon, the longest first."""
    return "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))


def _character(code: Column) -> Column:
    """The character of a numeric reference."""
    replaced = F.element_at(F.create_map(*(F.lit(x) for pair in C.REPLACED_CODES for x in pair)), code)
    silent = (code < 32) & ~code.isin(9, 10, 12, 13) | code.between(0x7F, 0x9F) | code.between(0xFDD0, 0xFDEF)
    silent = silent | (code >= 0xFFFE) & F.shiftright(code, 0).bitwiseAND(F.lit(0xFFFE).cast("long")).eqNullSafe(0xFFFE) | (code == 0xB)
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    out_of_range = code.between(0xD800, 0xDFFF) | (code > 0x10FFFF) | code.isNull()
    return F.when(code == 0, "�").when(replaced.isNotNull(), replaced).when(out_of_range, "�").when(silent, "").otherwise(plain)


def _decoded(piece: Column) -> Column:
    """Text of one piece: a reference, or what lies between references."""
    digits = lambda pattern, base: F.conv(
        F.when(F.length(F.regexp_extract(piece, pattern, 1)) > 15, "FFFFFF" if base == 16 else "99999999").otherwise(
            F.regexp_extract(piece, pattern, 1)), base, 10).cast("long")
    rest = F.substring(piece, 2, 40)
    short = F.regexp_extract(rest, f"^(?:{_short_names()})", 0)
    named = F.coalesce(
        F.element_at(_names(), rest),
        F.when(short != "", F.concat(F.element_at(_names(), short), F.substr(rest, F.length(short) + 1))),
        piece,
    )
    return (
        F.when(~F.startswith(piece, F.lit("&")) | (F.length(piece) == 1), piece)
        .when(F.rlike(piece, F.lit("^&#[xX]")), _character(digits(r"^&#[xX]0*([0-9a-fA-F]+)", 16)))
        .when(F.startswith(piece, F.lit("&#")), _character(digits(r"^&#0*([0-9]+)", 10)))
        .otherwise(named)
    )


def unescape(text: Column) -> Column:
    """Character references of HTML decoded: numeric ones, names, and the old names without a semicolon."""
    pieces = F.regexp_extract_all(text, F.lit(f"{FLAGS}{REFERENCE}|[^&]++|&"), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, _decoded), "")).otherwise(text)


def strip_tags_simple(text: Column) -> Column:
    """Tags to line breaks and references decoded, for text the tokens cannot take."""
    out = unescape(F.regexp_replace(text, C.ANY_TAG, "\n"))
    return py_strip(F.regexp_replace(out, "\n{3,}", "\n\n"))


def _token_text(token: Column) -> Column:
    raw = F.rlike(token, F.lit(f"{FLAGS}^{RAW}"))
    body = F.regexp_replace(F.regexp_replace(token, f"{FLAGS}^{RAW}", ""), f"{FLAGS}{RAW_END}\\z", "")
    block = F.rlike(token, F.lit(rf"(?i)^</?(?:{'|'.join(C.BLOCK_TAGS)})(?:[\s/>]|\z)"))
    closed = F.endswith(token, F.lit(">"))
    return (
        F.when(~F.startswith(token, F.lit("<")) | (token == "<"), unescape(token))
        .when(raw, F.when(F.rlike(token, F.lit(f"{FLAGS}{RAW_END}\\z")), body).otherwise(""))
        .when(block & closed, MARK)
        .otherwise("")
    )


def _page_text(source: Column) -> Column:
    tokens = F.regexp_extract_all(F.translate(source, MARK, ""), F.lit(FLAGS + TOKENS), F.lit(0))

    def joined(t: Column) -> Column:
        last = F.element_at(t, -1)
        held = (last == "<") | ~F.startswith(last, F.lit("<")) & F.rlike(last, F.lit(UNFINISHED))
        kept = F.when(held, F.slice(t, 1, F.size(t) - 1)).otherwise(t)
        marked = F.regexp_replace(F.array_join(F.transform(kept, _token_text), ""), f"(^|\n){MARK}+", "$1")
        return py_strip(F.regexp_replace(F.regexp_replace(marked, f"{MARK}+", "\n"), "\n{3,}", "\n\n"))

    return let(
        tokens,
        lambda t: F.when(F.array_contains(t, F.lit("<![")), strip_tags_simple(source)).otherwise(joined(t)),
    )


def strip_html(text: Column) -> Column:
    """Text of a page; text without tags is returned as it is."""
    return F.when(has_html(text), _page_text(text)).otherwise(text)
