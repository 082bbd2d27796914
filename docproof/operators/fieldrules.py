"""Rules of the staged design: label lookup, normalisation and merging of per-field results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docproof import constants as C
from docproof.functions.currency import currency_code
from docproof.functions.text import fold_text, py_strip

LABELLED = r"^[ \t]*{}[ \t]*(?:[:#]|[ \t])[ \t]*([^\n]*[^\s])[ \t]*$"


def labelled_value(text: Column, label: str, lower: Column | None = None) -> Column:
    """What follows a label at the start of a line, null when the label is missing; ``lower`` is the text in lower case."""
    pattern = "(?imd)" + LABELLED.format(re.escape(label).replace("\\ ", " "))
    # The plain substring test spares most labels the regular expression.
    named = F.contains(F.lower(text) if lower is None else lower, F.lit(label.lower()))
    return F.when(named, F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")))


def label_extract(text: Column, lower: Column | None = None) -> dict[str, Column]:
    """Per field the value after its first label found, in order of priority."""
    found = {
        field: F.coalesce(*(labelled_value(text, label, lower) for label in labels))
        for field, labels in C.FIELD_LABELS.items()
        if labels
    }
    found["currency"] = currency_code(text)
    return found


def reject_placeholder(value: Column) -> Column:
    """Null for texts that only repeat a label."""
    return F.when(~py_strip(value).isin(*C.PLACEHOLDERS), value)


def vat_format_ok(value: Column) -> Column:
    return F.coalesce(F.rlike(value, F.lit(r"^[A-Za-z0-9]{10,20}$")), F.lit(False))


def vat_format_ksa(value: Column) -> Column:
    return F.coalesce(F.rlike(value, F.lit(r"^[0-9]{15}$")), F.lit(False))


def evidence_grounded(value: Column, evidence: Column, folded_text: Column) -> Column:
    """The value or the evidence given for it occurs in the text."""
    occurs = lambda c: F.coalesce((fold_text(c) != "") & F.contains(folded_text, fold_text(c)), F.lit(False))
    return occurs(value) | occurs(evidence)


def weighted_confidence(
    scores: dict[str, Column], errors: Column | None = None, warnings: Column | None = None,
    error_penalty: int = 0, warning_penalty: int = 0,
) -> Column:
    """Weighted score in ten-thousandths less penalties; scores and penalties are in hundredths."""
    total = F.lit(0)
    for field, weight in C.FIELD_WEIGHTS.items():
        total = total + F.coalesce(scores[field], F.lit(0)) * weight
    if errors is not None:
        total = total - errors * (error_penalty * 100)
    if warnings is not None:
        total = total - warnings * (warning_penalty * 100)
    return total


def merge_field_results(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per-field rows to one row per document. Of several answers for a field the best scored is kept.

    The fields are fixed, so the wide row is built by conditional aggregates that combine before the shuffle; no
    list of rows is collected.
    """
    best = {
        f: F.max(F.when(F.col("field") == f, F.struct("score", "value", "evidence"))).alias(f"best_{f}")
        for f in C.STAGED_FIELDS
    }
    merged = results.groupBy(key).agg(*best.values())
    pairs = lambda name: F.create_map(
        *(x for f in C.STAGED_FIELDS for x in (F.lit(f), F.col(f"best_{f}.{name}")))
    )
    return merged.select(
        key,
        *(F.col(f"best_{f}.value").alias(f) for f in C.STAGED_FIELDS),
        pairs("evidence").alias("_evidence"),
        pairs("score").alias("_confidences"),
    )


def engine_compare(results: DataFrame, truth: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Share of right answers per engine and field against ``truth(key, field, expected)``.

    Results that carry ``expected`` themselves need no truth, and no join.
    """
    match = F.coalesce(fold_text(F.col("value")) == fold_text(F.col("expected")), F.lit(False)).cast("long")
    return (
        (results if truth is None else results.join(truth, [key, "field"]))
        .groupBy("engine", "field")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(match).alias("n_right"))
        .withColumn("accuracy", F.round(F.col("n_right") / F.col("n"), 4))
    )
