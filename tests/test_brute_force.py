"""Expressions against plain Python on many random texts, with characters the engines treat differently."""

import random
import re

from pyspark.sql import functions as F

from docproof.functions import numbers, text
from docproof.operators.scoring import TIE_WEIGHTS, confidence_of_counts

ALPHABET = list("aB9 0.,,..--\t\n\r_\u00e9") + [
    "\u0661", "\u06f8", "\u066b", "\xa0", "\u2003", "\u2028", "\x1c", "\x85", "\u2167", "\u0651", "\u0631", "\r\n", "\xbd",
]
DIGITS = {**{c: str(i) for i, c in enumerate("٠١٢٣٤٥٦٧٨٩")}, **{c: str(i) for i, c in enumerate("۰۱۲۳۴۵۶۷")}}


def texts(n=3000, size=14):
    rng = random.Random(7)
    return ["".join(rng.choices(ALPHABET, k=rng.randrange(size))) for _ in range(n)]


def apply(spark, fn, inputs):
    df = spark.createDataFrame(list(enumerate(inputs)), "i int, v string").select("i", fn(F.col("v")).alias("r"))
    return [r["r"] for r in sorted(df.collect(), key=lambda r: r["i"])]


def fold(s):
    return "".join(DIGITS.get(c, c) for c in s.lower() if c.isalnum())


def number(s):
    s = "".join(DIGITS.get(c, c) for c in s if not c.isspace()).replace("٫", ".")
    if "," in s:
        head, _, tail = s.rpartition(",")
        decimal = ("." in s and "." not in tail) or ("." not in s and tail.isdecimal() and len(tail) <= 2)
        if "." in s:
            s = s.replace(".", "").replace(",", ".") if decimal else s.replace(",", "")
        else:
            s = s.replace(",", "." if decimal else "")
    kept = "".join(c for c in s if c.isdecimal() or c in ".-")
    try:
        return float(kept)
    except ValueError:
        return None


def printed_amounts(s):
    runs, current = [], ""
    for c in s + "x":
        if c.isdecimal() or c.isspace() or c in ".,٫":
            current += c
        elif current:
            runs.append(current)
            current = ""
    return {round(n, 2) for n in map(number, runs) if n is not None}


def test_fold(spark):
    inputs = texts()
    assert apply(spark, text.fold_text, inputs) == [fold(s) for s in inputs]


def test_number(spark):
    inputs = texts(size=9)
    assert apply(spark, numbers.normalize_number, inputs) == [number(s) for s in inputs]


CLEANED = {
    "a \t b": "a b", " a ": "a", "a\n\n\nb": "a\n\nb", "a\n a\na ": "a", "a\nb\na": "a\nb\na", "\n\n": "", "a\x1cb": "a\nb",
    "a\xa0\u2003b": "a b", "a\u2028a": "a", "x  y\r\nx y\r\n\r\nz": "x y\n\nz", "A\na": "A\na", "a\x85 \x85b": "a\n\nb",
}


def test_clean_by_hand(spark):
    assert apply(spark, text.clean_ocr, list(CLEANED)) == list(CLEANED.values())


def test_clean_keeps_its_promises(spark):
    inputs = texts(size=30)
    once = apply(spark, text.clean_ocr, inputs)
    assert apply(spark, text.clean_ocr, once) == once  # nothing is left to do
    for before, after in zip(inputs, once):
        lines = after.split("\n")
        assert after == after.strip() and all(line == line.strip() for line in lines)
        assert not re.search("[ \t\xa0\u2003]{2}|[\t\xa0\u2003]", after)
        assert all(x != y for x, y in zip(lines, lines[1:]))
        # Words stay in their order: only whole lines equal to the one before them are gone.
        words, rest = after.split(), iter(before.split())
        assert all(w in rest for w in words) and set(words) == set(before.split())


def test_lines(spark):
    inputs = [t for t in texts(size=20) if t]
    assert apply(spark, text.split_lines, inputs) == [s.splitlines() for s in inputs]


def test_amounts(spark):
    inputs = texts(size=25)
    got = apply(spark, numbers.text_amounts, inputs)
    assert [set(g) for g in got] == [printed_amounts(s) for s in inputs]


def test_confidence_rounds_like_binary_floats(spark):
    """Every reachable combination of scores against the plain mean of doubles."""
    combos = []
    for a in range(4):
        for d in range(2):
            for o in range(13):
                for m in range(17 - a - d - o):
                    for w in range(17 - a - d - o - m):
                        combos.append((a, d, o, m, w))
    df = spark.createDataFrame(combos, "c0 int, c1 int, c2 int, c3 int, c4 int")
    counts = F.struct(*df.columns)
    got = {tuple(r)[:5]: r["conf"] for r in df.withColumn("conf", confidence_of_counts(counts)).collect()}
    for combo, value in got.items():
        scores = [s for s, k in zip((0.99, 0.98, 0.97, 0.10, 0.40), combo) for _ in range(k)]
        assert value == (round(sum(scores) / len(scores), 2) if scores else 1.0), combo
    assert len(TIE_WEIGHTS) == 5
