"""The main job: recognised text and model answers to validated, scored documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docproof import constants as C
from docproof.functions.canonical import flat_document_type, is_present_json
from docproof.functions.jsonio import timings_map
from docproof.operators import validation as val
from docproof.operators.scoring import field_score

def validation_struct() -> Column:
    """Everything known about the check of a document, kept whole with the stored record."""
    return F.struct(
        "valid",
        "issues",
        val.states_map().alias("field_states"),
        val.confidences_map().alias("field_confidences"),
        F.col("confidence").alias("score"),
        F.array().cast("array<string>").alias("required_fields"),
    )


def with_sections(checked: DataFrame) -> DataFrame:
    """Add ``j_<section>``: the JSON of each nested section of the answer, written once; null where there is none."""
    given = {f"j_{name}": F.to_json(F.try_variant_get("answer", f"$.{name}", "variant")) for name in C.EMPTY_SECTIONS}
    return checked.withColumns(given)


def _section(name: str) -> Column:
    """JSON of a nested section as the model gave it; an absent one is empty, without an answer it is blank."""
    given = F.col(f"j_{name}")
    blank = F.to_json(F.parse_json(F.lit(C.EMPTY_SECTIONS[name])))
    return F.when(is_present_json(given), given).when(F.col("answer").isNull(), blank).otherwise("{}")


def _document_section() -> Column:
    """The document section with the normalised currency; a section that is no object stays as it is."""
    currency, section = F.col("v_currency"), _section("document")
    document = F.coalesce(F.try_variant_get("answer", "$.document", "variant"), F.parse_json(section))
    entries = F.try_variant_get(document, "$", "map<string,variant>")
    own = F.create_map(F.lit("currency"), currency.cast("variant"))
    changed = F.to_variant_object(F.map_concat(F.map_filter(entries, lambda k, _: k != "currency"), own))
    # Most sections hold the normalised currency as it is, so nothing changes.
    held = F.try_variant_get("answer", "$.document.currency", "variant")
    same = F.coalesce((held.cast("string") == currency) & (F.schema_of_variant(held) == "STRING"), F.lit(False))
    kept = (currency == "") | same | ~F.startswith(section, F.lit("{"))
    return F.when(kept, section).otherwise(F.to_json(changed))


def payload_json() -> Column:
    """The stored JSON: flat fields, the sections of the answer whole, and the private confidence and validation entries.

    Amounts are read for the flat fields only; in their section they stay as the model wrote them. Needs ``with_sections``;
    its JSON is put between the other entries as it is.
    """
    flat = [F.col(f"v_{f}").alias(f) for f in C.FIELDS[:13]]
    checked = F.struct(
        "valid", "issues", val.states_map().alias("field_states"), val.confidences_map().alias("field_confidences")
    )
    written = lambda *entries: F.to_json(F.struct(*entries), {"ignoreNullFields": "false"})
    head = written(*flat, flat_document_type(F.col("answer")).alias("document_type"))
    tail = written(F.col("confidence").alias("_confidence"), checked.alias("_validation"))
    sections = {"document": _document_section()} | {
        name: _section(name) for name in ("vendor", "customer", "financials", "metadata")
    }
    return F.concat(
        F.regexp_replace(head, r"\}\z", ""),
        *(part for name, json in sections.items() for part in (F.lit(f',"{name}":'), json)),
        F.lit(","),
        F.substr(tail, F.lit(2)),
    )


def process_documents(documents: DataFrame, strict: bool = False) -> DataFrame:
    """One result row per input row, in one pass without a shuffle.

    Needs ``doc_id``, ``original_filename``, ``ocr_text``, ``raw_llm_response`` and ``processing_timings``; takes
    ``page_count`` (else 1) and carries other columns along, ``file_path`` and ``session_id`` among them.
    """
    checked = with_sections(val.validate(documents, strict))
    checked = checked.withColumn("timings", timings_map(F.col("processing_timings")))
    timings = F.col("timings")
    seconds = F.aggregate(F.map_values(timings), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    used = ("doc_id", "original_filename", "ocr_text", "processing_timings", "page_count")
    carried = [c for c in documents.columns if c not in used]
    pages = F.coalesce(F.col("page_count").cast("int"), F.lit(1)) if "page_count" in documents.columns else F.lit(1)
    return checked.select(
        F.col("doc_id").alias("document_id"),
        F.col("original_filename").alias("filename"),
        F.lit("invoice").alias("document_type"),
        "status",
        "confidence",
        F.lit(C.ENGINE).alias("extraction_engine"),
        validation_struct().alias("validation"),
        payload_json().alias("json_output"),
        F.col("ocr_text").alias("raw_text"),
        F.lit("").alias("excel_file_path"),
        F.round(seconds, 4).alias("processing_time"),
        pages.alias("page_count"),
        timings.alias("processing_timings"),
        *carried,
    )


def document_rows(processed: DataFrame) -> DataFrame:
    """Rows of the documents table."""
    return processed.select(
        F.col("document_id").alias("id"),
        *(["session_id"] if "session_id" in processed.columns else []),
        "filename",
        F.col("filename").alias("original_filename"),
        (F.col("file_path") if "file_path" in processed.columns else F.lit(None).cast("string")).alias("file_path"),
        "document_type",
        "json_output",
        F.col("raw_text").alias("ocr_text"),
        "raw_llm_response",
        F.col("json_output").alias("extracted_json"),
        F.to_json("validation", {"ignoreNullFields": "false"}).alias("validation_result"),
        "excel_file_path",
        "confidence",
        "status",
        "processing_time",
        "page_count",
        "extraction_engine",
        F.to_json("processing_timings").alias("processing_timings"),
        *(["created_at", F.col("created_at").alias("updated_at")] if "created_at" in processed.columns else []),
    )


def extraction_rows(documents: DataFrame) -> DataFrame:
    """The extraction logged with each stored document."""
    return documents.select(
        F.col("id").alias("document_id"),
        F.col("ocr_text").alias("raw_text"),
        "json_output",
        F.col("extraction_engine").alias("engine"),
        "confidence",
    )


def audit_rows(documents: DataFrame) -> DataFrame:
    """The audit entry logged with each stored document."""
    payload = F.struct(
        "document_type",
        "status",
        "confidence",
        F.col("extraction_engine").alias("engine"),
        "ocr_text",
        "raw_llm_response",
        "json_output",
        F.col("validation_result").alias("validation_corrections"),
    )
    return documents.select(
        F.col("id").alias("document_id"),
        F.lit("system").alias("actor"),
        F.lit("processed").alias("event_type"),
        F.to_json(payload).alias("payload"),
    )


def persist_projections(processed: DataFrame) -> dict[str, DataFrame]:
    """Rows of the three tables a processed document is written to."""
    documents = document_rows(processed)
    return {
        "documents": documents,
        "extractions": extraction_rows(documents),
        "audit_logs": audit_rows(documents),
    }


def review_queue(checked: DataFrame, threshold: float = C.REVIEW_THRESHOLD) -> DataFrame:
    """Per document and shown field: its confidence and whether it asks for review; fields never checked count as sure."""
    sure = F.lit(100)
    score = lambda f: F.coalesce(field_score(f, F.col(f"s_{f}")), sure) if f in C.FIELDS else sure
    entries = F.array(*(F.struct(F.lit(f).alias("field"), score(f).alias("score")) for f in C.CANONICAL_FIELDS))
    confidence = F.col("score") / F.lit(100.0)
    return checked.select("doc_id", F.inline(entries)).select(
        "doc_id", "field", confidence.alias("confidence"), (confidence < threshold).alias("needs_review")
    )


def with_model_response(
    documents: DataFrame, answer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
) -> DataFrame:
    """Hook for a user's own batch inference: ``(doc_id, ocr_text)`` in, ``(doc_id, raw_llm_response)`` out."""
    return documents.select("doc_id", "ocr_text").mapInPandas(answer, "doc_id long, raw_llm_response string")
