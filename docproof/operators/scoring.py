"""Field scores, the document confidence and the status derived from them.

Scores are integers in hundredths. The published confidence is the mean of the relevant scores rounded to two
decimals the way binary floating point rounds it, so exact ties do not always go up; the ties that go down are
listed once by plain arithmetic and looked up by the counts of each score.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from docproof import constants as C

# Weights of the counts (amounts valid, date valid, others valid, not extracted, incorrect) in the tie code.
TIE_WEIGHTS = (10000, 5000, 300, 17, 1)
_SCORES = (99, 98, 97, C.SCORE_MISSING, C.SCORE_INCORRECT)


@lru_cache(maxsize=1)
def ties_rounded_down() -> tuple[int, ...]:
    codes = []
    for counts in product(range(4), range(2), range(13), range(17), range(17)):
        n = sum(counts)
        total = sum(s * k for s, k in zip(_SCORES, counts))
        # Only an exact half in the third decimal can go either way.
        if not 0 < n <= len(C.FIELDS) or (2 * total) % n or (2 * total // n) % 2 == 0:
            continue
        scores = [s / 100 for s, k in zip(_SCORES, counts) for _ in range(k)]
        if round(sum(scores) / n, 2) < (2 * total + n) // (2 * n) / 100:
            codes.append(sum(w * k for w, k in zip(TIE_WEIGHTS, counts)))
    return tuple(sorted(codes))


def valid_score(field: str) -> int:
    kind = "amount" if field in C.AMOUNT_FIELDS else field
    return C.SCORE_VALID.get(kind, C.SCORE_VALID["other"])


def field_score(field: str, state: Column) -> Column:
    """Score of one field in hundredths."""
    return (
        F.when(state == C.VALID, valid_score(field))
        .when(state == C.ABSENT, C.SCORE_ABSENT)
        .when(state == C.MISSING, C.SCORE_MISSING)
        .otherwise(C.SCORE_INCORRECT)
    )


def score_counts(states: dict[str, Column]) -> Column:
    """How many fields earned each score."""
    valid = {f: (s == C.VALID).cast("int") for f, s in states.items()}
    amounts = sum((valid[f] for f in C.AMOUNT_FIELDS), F.lit(0))
    date = valid["document_date"]
    others = sum((v for f, v in valid.items() if f not in C.AMOUNT_FIELDS and f != "document_date"), F.lit(0))
    missing = sum(((s == C.MISSING).cast("int") for s in states.values()), F.lit(0))
    wrong = sum(((s == C.INCORRECT).cast("int") for s in states.values()), F.lit(0))
    return F.struct(*(c.alias(f"c{i}") for i, c in enumerate((amounts, date, others, missing, wrong))))


def confidence_of_counts(counts: Column) -> Column:
    """Mean score of the fields present on the document; 1.0 when there is none."""
    parts = [counts[f"c{i}"] for i in range(len(_SCORES))]
    n = sum(parts[1:], parts[0])
    total = sum((p * s for p, s in zip(parts, _SCORES)), F.lit(0))
    code = sum((p * w for p, w in zip(parts, TIE_WEIGHTS)), F.lit(0))
    # floor((2 total + n) / 2n) is the mean rounded half up.
    half_up = F.floor((total * 2 + n) / (n * 2)).cast("int")
    down = F.when(code.isin(*ties_rounded_down()), 1).otherwise(0)
    return F.when(n > 0, (half_up - down) / F.lit(100.0)).otherwise(F.lit(1.0))


def document_status(confidence: Column, low_field: Column) -> Column:
    return (
        F.when(confidence <= C.REJECT_THRESHOLD, C.REJECTED)
        .when(low_field, C.NEEDS_REVIEW)
        .otherwise(C.APPROVED)
    )
