"""Small tables for the edge cases every operator has to define."""

from __future__ import annotations

LONG = "lorem ipsum dolor sit amet " * 20_000


def documents(spark, rows, extra: bool = True):
    """documents from (doc_id, text[, lang]); with columns whose names the operators use themselves."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, len(r[1] or ""), 1.5, "x", "y") for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, label string"
    found = spark.createDataFrame(full, schema)
    return found if extra else found.select("doc_id", "text", "lang", "source", "n_chars")


EDGES = [(1, None), (2, ""), (3, "   "), (4, "word"), (5, LONG), (6, "same text here now"), (7, "same text here now"),
         (7, "same text here now"), (None, "no id at all"), (8, "été Ünïcode 漢字 😀"), (9, "12 34 !!"), (10, "\x00 odd \x1c marks")]
