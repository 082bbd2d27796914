"""Checks every extracted field against the text it was read from.

The whole module is row-local: one scan, no shuffle. Text is folded and its amounts are listed once per row,
before any field looks at them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docproof import constants as C
from docproof.functions import canonical as canon
from docproof.functions import numbers as num
from docproof.functions import text as tx
from docproof.functions.currency import contains_any, normalize_currency
from docproof.functions.dates import is_valid_date
from docproof.functions.jsonio import parse_model_json
from docproof.operators import scoring

#: For a field: is it named in the text, and is its value found there?
Facts = Callable[[str], tuple[Column, Column]]
ISSUE_TYPE = "array<struct<field:string,message:string,severity:string>>"


def evaluate_once(df: DataFrame, *columns: str) -> DataFrame:
    """Fix the given columns per row.

    The optimizer copies an expression into every filter that is pushed below it, which for the states would repeat
    their text searches many times. It does not push filters into a generator, so the columns are passed through one.
    """
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, F.inline(F.array(F.struct(*columns))))


def with_answer(df: DataFrame, response: str = "raw_llm_response") -> DataFrame:
    """Add ``answer``: the model's JSON object as a variant."""
    return df.withColumn("answer", parse_model_json(F.col(response)))


def with_field_values(df: DataFrame) -> DataFrame:
    """Add one ``v_<field>`` column per validated field: text, or double for the three amounts."""
    given = F.col("answer_values")
    values, stripped = {}, {}
    for field in C.FIELDS:
        if field in C.AMOUNT_FIELDS:
            values[f"v_{field}"] = canon.read_amount(canon.value_at(given, C.FIELD_PATHS[field]))
            continue
        values[f"v_{field}"] = canon.value_at(given, C.FIELD_PATHS[field])
        if field not in ("purchase_order", "customer_vat", "payment_terms"):
            stripped[f"v_{field}"] = F.coalesce(tx.strip_column(f"v_{field}"), F.lit(""))
    looked_up = df.withColumn("answer_values", canon.flat_values(F.col("answer")))
    found = looked_up.withColumns(values).drop("answer_values").withColumns(stripped)
    return found.withColumn("v_currency", normalize_currency(F.col("v_currency")))


def with_text_index(df: DataFrame, text: str = "ocr_text", strict: bool = False) -> DataFrame:
    """Add the lower-cased text, its folded form and the amounts printed in it."""
    source = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn("ocr_lower", F.lower(source)).withColumns(
        {
            "ocr_fold": F.regexp_replace(tx.fold_digits(F.col("ocr_lower"), strict), tx.NON_ALNUM, ""),
            "ocr_amounts": num.text_amounts(source, strict),
        }
    )


def field_mentioned(field: str, lower_text: Column) -> Column:
    """Does the text name the field? Vendors always count as named."""
    if field in C.VENDOR_FIELDS:
        return F.lit(True)
    return contains_any(lower_text, C.FIELD_KEYWORDS.get(field, (field.replace("_", " "),)))


def date_grounded(value: Column, folded_text: Column, strict: bool = False) -> Column:
    """Some digit group of the date (all of them when ``strict``) occurs in the text."""
    groups = F.regexp_extract_all(value, F.lit(r"\p{Nd}+"), F.lit(0))
    test = F.forall if strict else F.exists
    return F.coalesce(test(groups, lambda g: F.contains(folded_text, g)), F.lit(False))


def currency_grounded(value: Column, lower_text: Column, folded_text: Column) -> Column:
    return F.when(F.upper(tx.py_strip(value)) == "SAR", contains_any(lower_text, C.RIYAL_MARKS)).otherwise(
        text_grounded(value, folded_text)
    )


def text_grounded(value: Column, folded_text: Column, strict: bool = False) -> Column:
    return F.contains(folded_text, tx.fold_text(value, strict))


def value_text(field: str, value: Column) -> Column:
    return num.number_text(value) if field in C.AMOUNT_FIELDS else value


def _grounded(field: str, strict: bool) -> Column:
    value, lower, fold = F.col(f"v_{field}"), F.col("ocr_lower"), F.col("ocr_fold")
    if field in C.AMOUNT_FIELDS:
        return num.amount_in(value, F.col("ocr_amounts"))
    if field == "document_date":
        return is_valid_date(value) & date_grounded(value, fold, strict)
    if field == "currency":
        return currency_grounded(value, lower, fold)
    return text_grounded(value, fold, strict)


def field_state(field: str, strict: bool = False, facts: Facts | None = None) -> Column:
    """One of the four states, from the ``v_`` and text index columns, or from facts about the text found elsewhere."""
    value = F.col(f"v_{field}")
    empty = value.isNull() if field in C.AMOUNT_FIELDS else tx.is_empty_value(value)
    named, found = facts(field) if facts else (field_mentioned(field, F.col("ocr_lower")), _grounded(field, strict))
    return F.when(~named, C.ABSENT).when(empty, C.MISSING).when(found, C.VALID).otherwise(C.INCORRECT)


def with_field_states(df: DataFrame, strict: bool = False, facts: Facts | None = None) -> DataFrame:
    """Add ``s_<field>`` for every field and ``math_failed``; the final state of the total includes the sum check."""
    subtotal, tax, total = (F.col(f"v_{f}") for f in C.AMOUNT_FIELDS)
    states = {f"s_{f}": field_state(f, strict, facts) for f in C.FIELDS if f != "total_amount"}
    states["found_total_amount"] = field_state("total_amount", strict, facts)
    states["math_failed"] = F.coalesce(
        F.abs(subtotal + tax - total) > C.MATH_TOLERANCE, F.lit(False)
    )
    final_total = F.when(F.col("math_failed"), C.INCORRECT).otherwise(F.col("found_total_amount"))
    return df.withColumns(states).withColumn("s_total_amount", final_total)


def _wrong_message(field: str) -> Column:
    value = value_text(field, F.col(f"v_{field}"))
    if field in C.AMOUNT_FIELDS:
        return F.concat(F.lit("Amount '"), value, F.lit(f"' for '{field}' not found in OCR text."))
    if field == "document_date":
        return F.when(
            is_valid_date(F.col(f"v_{field}")),
            F.concat(F.lit("Date digits from '"), value, F.lit("' are not grounded in OCR text.")),
        ).otherwise(F.concat(F.lit("Document date '"), value, F.lit("' is not a valid date format.")))
    if field == "currency":
        return F.concat(F.lit("Currency '"), value, F.lit("' is not grounded in OCR text."))
    return F.concat(F.lit(f"Field '{field}' value '"), value, F.lit("' is not present in OCR text."))


def _issue(field: str, message: Column, severity: str) -> Column:
    return F.struct(F.lit(field).alias("field"), message.alias("message"), F.lit(severity).alias("severity"))


def issues_column() -> Column:
    """The list of issues in field order, the sum check last."""
    found = []
    for field in C.FIELDS:
        state = F.col("found_total_amount" if field == "total_amount" else f"s_{field}")
        missing = _issue(
            field,
            F.lit(f"Field '{field}' exists in OCR but was not extracted."),
            "error" if field in C.ERROR_IF_MISSING else "warning",
        )
        wrong = _issue(field, _wrong_message(field), "error" if field in C.ERROR_IF_INCORRECT else "warning")
        found.append(F.when(state == C.MISSING, missing).when(state == C.INCORRECT, wrong))
    subtotal, tax, total = (F.col(f"v_{f}") for f in C.AMOUNT_FIELDS)
    message = F.concat(
        F.lit("Math check failed: subtotal ("),
        num.number_text(subtotal),
        F.lit(") + tax ("),
        num.number_text(tax),
        F.lit(") = "),
        F.format_string("%.2f", subtotal + tax),
        F.lit(", but total is "),
        num.number_text(total),
        F.lit("."),
    )
    found.append(F.when(F.col("math_failed"), _issue("total_amount", message, "error")))
    return F.array_compact(F.array(*found))


def penalty_column() -> Column:
    """Sum of the penalties in hundredths. A diagnostic only: the confidence does not use it."""
    total = F.when(F.col("math_failed"), C.PENALTY["math"]).otherwise(0)
    for field in C.FIELDS:
        state = F.col("found_total_amount" if field == "total_amount" else f"s_{field}")
        weight = C.PENALTY.get(field, C.PENALTY["other"])
        total = total + F.when(state.isin(C.MISSING, C.INCORRECT), weight).otherwise(0)
    return total


def states_map() -> Column:
    return F.create_map(*(x for f in C.FIELDS for x in (F.lit(f), F.col(f"s_{f}"))))


def confidences_map() -> Column:
    pairs = (
        x
        for f in C.FIELDS
        for x in (F.lit(f), scoring.field_score(f, F.col(f"s_{f}")) / F.lit(100.0))
    )
    return F.create_map(*pairs)


def error_column() -> Column:
    """Is there an issue of severity error?"""
    error = F.col("math_failed")
    for field in C.FIELDS:
        state = F.col("found_total_amount" if field == "total_amount" else f"s_{field}")
        if field in C.ERROR_IF_MISSING:
            error = error | (state == C.MISSING)
        if field in C.ERROR_IF_INCORRECT:
            error = error | (state == C.INCORRECT)
    return error


def with_scores(df: DataFrame) -> DataFrame:
    """Add issues, valid flag, confidence, penalty and status."""
    states = {f: F.col(f"s_{f}") for f in C.FIELDS}
    low = F.lit(False)
    for state in states.values():
        # Only these two states score below the review threshold.
        low = low | state.isin(C.MISSING, C.INCORRECT)
    return (
        df.withColumns(
            {
                "score_counts": scoring.score_counts(states),
                "low_field": low,
                "valid": ~error_column(),
                "penalty": penalty_column(),
                "issues": issues_column(),
            }
        )
        .withColumn("confidence", scoring.confidence_of_counts(F.col("score_counts")))
        .withColumn("status", scoring.document_status(F.col("confidence"), F.col("low_field")))
        .drop("score_counts", "low_field")
    )


def validate(df: DataFrame, strict: bool = False) -> DataFrame:
    """Values, text index, states and scores for rows with ``ocr_text`` and ``raw_llm_response``."""
    indexed = with_text_index(with_field_values(with_answer(df)), strict=strict)
    return scored_states(with_field_states(indexed, strict))


def scored_states(states: DataFrame) -> DataFrame:
    fixed = [*(f"s_{f}" for f in C.FIELDS), "found_total_amount", "math_failed"]
    return with_scores(evaluate_once(states, *fixed))


def unpivot_values(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Long form ``(key, position, field, value)`` of the ``v_`` columns, without a shuffle."""
    entries = F.array(
        *(
            F.struct(
                F.lit(i).alias("position"), F.lit(f).alias("field"), value_text(f, F.col(f"v_{f}")).alias("value")
            )
            for i, f in enumerate(C.FIELDS, 1)
        )
    )
    return df.select(key, F.inline(entries))


def unpivot_states(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Long form ``(key, position, field, state, score)`` with the score in hundredths."""
    entries = F.array(
        *(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f).alias("field"),
                F.col(f"s_{f}").alias("state"),
                scoring.field_score(f, F.col(f"s_{f}")).alias("score"),
            )
            for i, f in enumerate(C.FIELDS, 1)
        )
    )
    return df.select(key, F.inline(entries))
