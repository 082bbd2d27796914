"""Every operator bound to the supplied tables, by name.

Results are flat: maps and lists are rendered as text so that any engine can be compared with them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docproof import constants as C
from docproof.functions import canonical as canon
from docproof.functions import currency as cur
from docproof.functions import dates as dt
from docproof.functions import jsonio as js
from docproof.functions import numbers as num
from docproof.functions import sqlfuncs
from docproof.functions import text as tx
from docproof.functions.html import strip_html
from docproof.functions.html import strip_tags_simple as tags_to_lines
from docproof.operators import analytics as an
from docproof.operators import assembly, daily, exports, ordered, pageflow, relations, reviews, scoring, search
from docproof.operators import fieldrules as rules
from docproof.operators import validation as val
from docproof.plans import bindings as b
from docproof.plans import process
from docproof.sources import tables
from docproof.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def scratch_dir(spark: SparkSession) -> str:
    """A new folder for a query that writes and reads back; shared by all executors."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        return tempfile.mkdtemp(prefix="docproof-")
    return f"{shared.rstrip('/')}/docproof-{uuid.uuid4().hex}"


def _map_text(m: Column) -> Column:
    """``k=v;k=v`` in key order."""
    entries = F.array_sort(F.map_entries(m))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")


def _issues_text(issues: Column) -> Column:
    return F.array_join(
        F.transform(issues, lambda i: F.concat_ws("|", i["field"], i["severity"], i["message"])), "\n"
    )


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return b.documents(spark, d)


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Invoices after processing, as rows of the documents table."""
    return process.persist_projections(process.process_documents(b.invoices(spark, d)))["documents"]


def _written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A table written to the scratch folder and read back, for operators that read it more than once."""
    path = scratch_dir(spark) + "/table"
    df.write.parquet(path)
    return spark.read.parquet(path)


def _parsed(documents: DataFrame) -> DataFrame:
    """Stored JSON parsed once per row."""
    return documents.withColumns(
        {"stored": js.read_object(F.col("extracted_json")), "validation": js.read_object(F.col("validation_result"))}
    )


def _checked(spark: SparkSession, d: str) -> DataFrame:
    return val.validate(b.invoices(spark, d))


def _values(spark: SparkSession, d: str) -> DataFrame:
    return val.with_field_values(val.with_answer(b.invoices(spark, d)))


# --- scans and sources ------------------------------------------------------------------------------------


@query
def scan_documents(spark, d):
    return tables.document_history(_documents(spark, d))


@query
def document_by_id(spark, d):
    return tables.document_by_id(_documents(spark, d), 4242).select(*tables.HISTORY_COLUMNS)


@query
def ingest_manifest(spark, d):
    files = read_table(spark, d, "pages").select("page_id", "url")
    bound = b.invoices(spark, d).select(F.col("doc_id").alias("page_id"), F.col("original_filename").alias("url"))
    listed = tables.ingest_manifest(files.unionByName(bound), F.col("url"), C.UPLOAD_SUFFIXES)
    return listed.select("page_id", "filename", "suffix", "accepted")


@query
def storage_name(spark, d):
    return b.invoices(spark, d).select(
        "doc_id", tables.storage_name(F.col("original_filename"), F.col("doc_id")).alias("stored_name")
    )


@query
def seed_if_empty(spark, d):
    return tables.seed_if_empty(_documents(spark, d)).select("id", "filename", "document_type", "status", "confidence")


@query
def seed_empty_store(spark, d):
    """The demo record appears because no document survives the impossible type filter."""
    none = _documents(spark, d).filter(F.col("document_type") == "no such type")
    return tables.seed_if_empty(none).select("id", "filename", "document_type", "status", "confidence", "json_output")


@query
def schema_backfill(spark, d):
    old = _documents(spark, d).drop("excel_file_path").withColumn(
        "extracted_json", F.when(F.col("id") % 3 == 0, "{}").when(F.col("id") % 3 == 1, "").otherwise('{"a":1}')
    )
    return tables.schema_backfill(old).select(
        "id", "ocr_text", "raw_llm_response", "extracted_json", "validation_result", "excel_file_path",
        "extraction_engine", "processing_timings",
    )


# --- sinks ------------------------------------------------------------------------------------------------


@query
def export_rows(spark, d):
    return exports.export_rows(_stored(spark, d), "id")


@query
def export_session(spark, d):
    return exports.export_session_rows(_stored(spark, d), "id")


def _read_back_columns(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("id").cast("long").alias("id"),
        *(
            (F.col(f"`{t}`").cast("double") if f in C.AMOUNT_FIELDS else F.coalesce(F.col(f"`{t}`"), F.lit(""))).alias(f)
            for t, f in C.EXPORT_COLUMNS
        ),
    )


@query
def csv_sink(spark, d):
    path = scratch_dir(spark) + "/csv"
    exports.write_csv(exports.export_rows(_stored(spark, d), "id"), path)
    schema = "id long, " + ", ".join(f"`{t}` {'double' if f in C.AMOUNT_FIELDS else 'string'}" for t, f in C.EXPORT_COLUMNS)
    return _read_back_columns(spark.read.schema(schema).option("header", True).option("escape", '"').csv(path))


@query
def json_sink(spark, d):
    path = scratch_dir(spark) + "/json"
    exports.write_json(exports.export_rows(_stored(spark, d), "id"), path)
    schema = "id long, " + ", ".join(f"`{t}` {'double' if f in C.AMOUNT_FIELDS else 'string'}" for t, f in C.EXPORT_COLUMNS)
    return _read_back_columns(spark.read.schema(schema).json(path))


@query
def session_export_files(spark, d):
    path = scratch_dir(spark) + "/sessions"
    exports.write_session_exports(exports.export_session_rows(_stored(spark, d), "id"), path)
    titles = {f: t for t, f in C.EXPORT_COLUMNS}
    shown = [F.col(f"`{titles[f]}`").alias(f) for f in ("document_number", "total_amount", "document_type")]
    return spark.read.parquet(path).select("session_id", "id", *shown)


@query
def export_col_width(spark, d):
    return exports.export_col_width(exports.export_session_rows(_stored(spark, d)))


def _persisted(spark, d):
    return process.persist_projections(process.process_documents(b.invoices(spark, d)))


@query
def persist_document(spark, d):
    return _persisted(spark, d)["documents"].select(
        "id", "session_id", "filename", "original_filename", "document_type", "status", "confidence", "ocr_text",
        "raw_llm_response", "page_count", "extraction_engine",
        F.get_json_object("extracted_json", "$.document_number").alias("document_number"),
        F.get_json_object("json_output", "$.vendor.name_en").alias("vendor_name_en"),
        F.get_json_object("validation_result", "$.field_states.document_date").alias("date_state"),
    )


@query
def persist_extractions(spark, d):
    return _persisted(spark, d)["extractions"].select("document_id", "raw_text", "engine", "confidence")


@query
def persist_audit(spark, d):
    payload = lambda k: F.get_json_object("payload", f"$.{k}")
    return _persisted(spark, d)["audit_logs"].select(
        "document_id", "actor", "event_type", payload("status").alias("status"),
        payload("confidence").cast("double").alias("confidence"), payload("ocr_text").alias("ocr_text"),
    )


@query
def set_export_path(spark, d):
    paths = b.sessions(spark, d).filter(F.col("created_at") >= "2001-06-01").select(
        F.col("id").alias("session_id"),
        F.concat(F.lit("exports/combined_export_"), F.col("id").cast("string"), F.lit(".xlsx")).alias("export_path"),
        F.lit(2).alias("seq"),
    )
    paths = paths.unionByName(paths.withColumn("export_path", F.lit("exports/zz_older.xlsx")).withColumn("seq", F.lit(1)))
    stamped = exports.set_export_path(_documents(spark, d), b.sessions(spark, d), paths)
    docs = stamped["documents"].select(F.lit("document").alias("kind"), "id", "excel_file_path")
    return docs.unionByName(stamped["sessions"].select(F.lit("session").alias("kind"), "id", "excel_file_path"))


# --- projections, filters, predicates ---------------------------------------------------------------------

_SHORT = ("id", "filename", "document_type", "status", "confidence")


@query
def search_text(spark, d):
    return search.search_documents(_documents(spark, d), search=" customer#0000001_7 ").select(*_SHORT)


@query
def search_text_indexed(spark, d):
    """By trigram postings written beside the documents."""
    docs = _documents(spark, d)
    path = f"{scratch_dir(spark)}/postings"
    search.text_postings(docs).write.parquet(path)
    return search.search_indexed(docs, spark.read.parquet(path), " customer#0000001 ").select(*_SHORT)


@query
def filter_type(spark, d):
    return search.search_documents(_documents(spark, d), document_type="1-URGENT").select(*_SHORT)


@query
def filter_status(spark, d):
    return search.search_documents(_documents(spark, d), status="Needs Review", document_type="").select(*_SHORT)


@query
def filter_date_range(spark, d):
    return search.filter_date_range(_documents(spark, d), "1997-02-01", "1997-03-15").select(*_SHORT)


@query
def documents_of_days(spark, d):
    """The same range of days from documents stored in folders of months, of which two are read."""
    path = scratch_dir(spark) + "/documents"
    daily.write_days(daily.with_day(_documents(spark, d).select(*_SHORT, "created_at")), path, "month")
    return daily.read_days(spark, path, "1997-02-01", "1997-03-15", "month").select(*_SHORT)


@query
def document_list(spark, d):
    return search.document_list(_documents(spark, d))


@query
def document_list_events(spark, d):
    """ISO timestamps with a fraction."""
    return b.audit_logs(spark, d).select("id", dt.iso_timestamp(F.col("created_at")).alias("created_at"))


@query
def select_ids(spark, d):
    docs = _documents(spark, d)
    return search.select_ids(docs, docs.filter(F.col("document_type") == "1-URGENT").select("id")).select(*_SHORT)


@query
def select_ids_newest(spark, d):
    docs = _documents(spark, d)
    return search.select_ids(docs, docs.filter(F.col("document_type") == "1-URGENT").select("id"), limit=1000).select(*_SHORT)


@query
def public_json(spark, d):
    events = read_table(spark, d, "events")
    payload = F.create_map(
        F.lit("_private"), F.col("props"), F.col("event_type"), F.col("user_id").cast("string"),
        F.concat(F.lit("_"), F.col("event_type")), F.lit("x"),
    )
    return events.select("event_id", _map_text(js.public_keys(payload)).alias("public"))


@query
def document_detail(spark, d):
    validation, stored = F.col("validation"), F.col("stored")
    return _parsed(_stored(spark, d)).select(
        "id", "filename", "status", "confidence", "page_count",
        F.try_variant_get(stored, "$.total_amount", "double").alias("total_amount"),
        F.try_variant_get(validation, "$.valid", "boolean").alias("valid"),
        F.size(F.try_variant_get(validation, "$.issues", "array<variant>")).cast("long").alias("n_issues"),
        _map_text(js.timings_map(F.col("processing_timings"))).alias("timings"),
    )


# --- joins ------------------------------------------------------------------------------------------------


def _reviews(spark, d):
    return b.review_edits(spark, d).select(
        "document_id", F.col("seq").alias("id"), F.col("status").alias("action"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
    )


@query
def document_with_children(spark, d):
    return relations.document_with_children(
        _documents(spark, d), b.extractions(spark, d), _reviews(spark, d), b.audit_logs(spark, d)
    )


@query
def session_documents(spark, d):
    return relations.session_documents(b.sessions(spark, d), _documents(spark, d))


@query
def session_view(spark, d):
    return relations.session_view(b.sessions(spark, d), _stored(spark, d)).select(
        "session_id", "session_name", "document_id", "status", "document_number", "vendor_name_en", "document_date",
        "currency", "total_amount", _map_text(F.col("field_states")).alias("field_states"),
        F.size(F.filter(F.map_values("field_confidences"), lambda c: c < 0.8)).cast("long").alias("n_low"),
    )


@query
def recent_sessions(spark, d):
    return relations.recent_sessions(b.sessions(spark, d), _documents(spark, d))


def _doomed(spark, d):
    return _documents(spark, d).filter(F.col("status") == "Rejected").select("id")


@query
def delete_document(spark, d):
    left = relations.delete_documents(
        _documents(spark, d), _doomed(spark, d),
        {"extractions": b.extractions(spark, d), "reviews": _reviews(spark, d), "audit_logs": b.audit_logs(spark, d)},
    )
    return _table_counts(left)


def _table_counts(left: dict[str, DataFrame]) -> DataFrame:
    """Rows and sum of keys left in every table."""
    out = None
    for name, table in left.items():
        key = "document_id" if "document_id" in table.columns else "id"
        row = table.agg(F.count(F.lit(1)).alias("n"), F.sum(key).alias("key_sum")).select(
            F.lit(name).alias("table_name"), "n", "key_sum"
        )
        out = row if out is None else out.unionByName(row)
    return out


@query
def delete_session(spark, d):
    sessions = b.sessions(spark, d)
    left = relations.delete_sessions(
        sessions, _documents(spark, d), sessions.filter(F.col("created_at") < "2001-06-01").select("id"),
        {"extractions": b.extractions(spark, d), "reviews": _reviews(spark, d), "audit_logs": b.audit_logs(spark, d)},
    )
    return _table_counts(left)


@query
def attach_session(spark, d):
    docs = _documents(spark, d)
    assignment = docs.filter(F.col("status") == "Needs Review").select(
        F.col("id").alias("document_id"), (F.col("id") + 1000000).alias("new_session_id"), F.lit(2).alias("seq")
    )
    older = assignment.withColumn("new_session_id", F.col("document_id") + 2000000).withColumn("seq", F.lit(1))
    assignment = assignment.unionByName(older)
    return relations.attach_session(docs, assignment).select("id", "session_id")


@query
def user_lookup(spark, d):
    customers = read_table(spark, d, "customer")
    active = read_table(spark, d, "events").select(F.col("user_id").alias("c_custkey"))
    return relations.lookup(customers, active, "c_custkey").select("c_custkey", "c_name")


# --- aggregations -----------------------------------------------------------------------------------------


@query
def docs_by_type(spark, d):
    return an.docs_by_type(_documents(spark, d))


@query
def daily_trend(spark, d):
    return an.daily_trend(b.audit_logs(spark, d))


@query
def confidence_distribution(spark, d):
    return an.confidence_distribution(_documents(spark, d))


@query
def confidence_summary(spark, d):
    """Confidences are whole hundredths, so the quantiles of the sketch are exact; of the histogram the counts are whole."""
    found = an.confidence_summary(_documents(spark, d))
    counted = F.aggregate("histogram", F.lit(0.0), lambda n, bin: n + bin["y"]).cast("long").alias("counted")
    return found.select(counted, *(F.get("quantiles", F.lit(i)).alias(f"q{p}") for i, p in enumerate((5, 25, 50, 75, 95))))


@query
def audit_count(spark, d):
    return an.audit_count(b.audit_logs(spark, d))


@query
def search_total(spark, d):
    return search.search_total(search.search_documents(_documents(spark, d), search="customer#00000001"))


@query
def session_accuracy(spark, d):
    return an.session_accuracy(b.sessions(spark, d), _checked(spark, d))


@query
def session_pending(spark, d):
    return an.session_pending(_documents(spark, d))


@query
def batch_summary(spark, d):
    return an.batch_summary(_documents(spark, d))


@query
def session_name(spark, d):
    files = b.invoices(spark, d).select(
        "session_id", F.col("original_filename").alias("filename"), F.col("doc_id").alias("pos")
    )
    return an.session_name(files)


@query
def ocr_telemetry(spark, d):
    return assembly.ocr_telemetry(b.doc_pages(spark, d))


@query
def stage_latency(spark, d):
    return an.stage_latency(b.invoices(spark, d))


@query
def latency_by_days(spark, d):
    """Stage latency of a range of days from the stored summaries of days."""
    path = scratch_dir(spark) + "/latency"
    daily.write_days(daily.latency_by_day(b.invoices(spark, d)), path, "month")
    return daily.latency_over(daily.read_days(spark, path, "1994-03-10", "1997-06-20", "month"))


@query
def confidence_by_days(spark, d):
    """Quantiles from the stored sketches of days, judged by their true ranks among the documents of these days."""
    path, days = scratch_dir(spark) + "/confidence", ("1994-03-10", "1997-06-20")
    shares = (0.05, 0.25, 0.5, 0.75, 0.95)
    documents = _documents(spark, d)
    daily.write_days(daily.confidence_by_day(documents), path, "month")
    found = daily.confidence_over(daily.read_days(spark, path, *days, "month"), shares)
    # The quantiles come in as one value of a subquery, so the documents are counted in one pass and joined to nothing.
    quantiles = found.select("quantiles").scalar()
    kept = search.filter_date_range(documents, *days).select("confidence", quantiles.alias("quantiles"))
    ranks = kept.agg(
        F.count(F.lit(1)).alias("n"),
        *(F.count_if(F.col("confidence") < F.col("quantiles")[i]).alias(f"below{i}") for i in range(len(shares))),
        *(F.count_if(F.col("confidence") <= F.col("quantiles")[i]).alias(f"upto{i}") for i in range(len(shares))),
    )
    close = lambda i, share: (F.col(f"below{i}") <= (share + daily.RANK_ERROR) * F.col("n")) & (
        F.col(f"upto{i}") >= (share - daily.RANK_ERROR) * F.col("n"))
    counted = found.select("counted").scalar()
    entries = [F.struct(F.lit(i + 1).alias("quantile_no"), close(i, s).alias("within_rank_error")) for i, s in enumerate(shares)]
    return ranks.select(F.inline(F.array(*entries))).select("quantile_no", counted.alias("counted"), "within_rank_error")


@query
def doc_confidence(spark, d):
    return _checked(spark, d).select("doc_id", "confidence")


# --- ordered scans ----------------------------------------------------------------------------------------


@query
def dedupe_adjacent_lines(spark, d):
    lines = tx.drop_repeated_lines(tx.split_lines(F.col("text")))
    return read_table(spark, d, "documents").select(
        "doc_id", F.array_join(lines, "\n").alias("text"), F.size(lines).cast("long").alias("n_lines")
    )


@query
def island_count(spark, d):
    return ordered.island_count(b.series(spark, d), "user_id", "value", "ts", "event_id")


@query
def island_count_tall(spark, d):
    """The same with a threshold that cuts the series into many runs."""
    return ordered.island_count(b.series(spark, d), "user_id", "value", "ts", "event_id", share=0.4)


@query
def page_role(spark, d):
    return assembly.page_role(b.doc_pages(spark, d)).select(
        "doc_id", "page_no", "is_first", "is_last",
        F.when(F.col("is_first"), F.col("header_text")).otherwise("").alias("header"),
        F.when(F.col("is_last"), F.col("footer_text")).otherwise("").alias("footer"),
    )


@query
def assemble_document_text(spark, d):
    return assembly.assemble_document_text(b.doc_pages(spark, d))


@query
def assemble_document_segments(spark, d):
    """Segments of three pages, as a document longer than one segment gives."""
    return assembly.assemble_document_text(b.doc_pages(spark, d), pages_per_segment=3)


@query
def assemble_token_stream(spark, d):
    return assembly.assemble_token_stream(b.token_chunks(spark, d))


# --- sort, limit, top-k -----------------------------------------------------------------------------------


@query
def sort_by_any(spark, d):
    return search.sort_by_any(_documents(spark, d), "confidence", descending=False).select(*_SHORT)


@query
def page_documents(spark, d):
    return search.page_documents(_documents(spark, d), page=3, sort="confidence").select(*_SHORT)


@query
def page_documents_unknown_sort(spark, d):
    return search.page_documents(_documents(spark, d), page=2, sort="no_such_column").select(*_SHORT)


@query
def page_ranked(spark, d):
    path = scratch_dir(spark)
    search.write_ranked(_documents(spark, d), path, sort="confidence", ranges=40)
    return search.page_ranked(spark, path, page=90, sort="confidence").select(*_SHORT)


@query
def page_after(spark, d):
    last = F.lit("1998-06-01").cast("timestamp_ntz")
    return search.page_after(_documents(spark, d), last, 700).select(*_SHORT)


@query
def newest_n(spark, d):
    return search.newest(_documents(spark, d), 1000).select(*_SHORT)


# --- keyed maintenance ------------------------------------------------------------------------------------


@query
def dedupe_uploads(spark, d):
    return reviews.dedupe_uploads(b.uploads(spark, d))


def _reviewed(spark, d, strict=False):
    return reviews.apply_review(_stored(spark, d), b.review_edits(spark, d), strict)


def _review_columns(df: DataFrame) -> DataFrame:
    stored, validation = F.col("stored"), F.col("validation")
    canonical = {c: canon.canonical_text(stored, c) for c in ("vendor_name_en", "document_number", "currency")}
    return _parsed(df).select(
        "id", "status", "confidence", "reviewed",
        js.json_path_text(stored, "$.document_number").alias("flat_number"),
        js.json_path_text(stored, "$.document.number").alias("nested_number"),
        js.json_path_text(stored, "$.vendor_name_en").alias("flat_vendor"),
        js.json_path_text(stored, "$.vendor.name_en").alias("nested_vendor"),
        F.try_variant_get(stored, "$.total_amount", "double").alias("flat_total"),
        canon.canonical_amount(stored, "total_amount").alias("exported_total"),
        *(c.alias(f"exported_{k}") for k, c in canonical.items()),
        F.try_variant_get(validation, "$.score", "double").alias("kept_score"),
        F.try_variant_get(validation, "$.valid", "boolean").alias("valid"),
        F.size(F.try_variant_get(validation, "$.issues", "array<variant>")).cast("long").alias("n_issues"),
        F.when(
            F.col("reviewed"), _map_text(F.try_variant_get(validation, "$.field_states", "map<string,string>"))
        ).alias("field_states"),
    )


@query
def apply_review(spark, d):
    return _review_columns(_reviewed(spark, d))


@query
def apply_review_strict(spark, d):
    return _review_columns(_reviewed(spark, d, strict=True))


@query
def review_audit(spark, d):
    return reviews.review_audit(b.review_edits(spark, d)).select(
        "document_id", "actor", "event_type", F.get_json_object("payload", "$.status").alias("status")
    )


@query
def session_reexport(spark, d):
    edits = b.review_edits(spark, d)
    rows = reviews.apply_review(reviews.touched_sessions(_written(spark, _stored(spark, d)), edits), edits)
    return exports.export_session_rows(rows, "id").select(
        "session_id", "id", F.col("Invoice Number").alias("document_number"), F.col("Currency").alias("currency"),
        F.col("Total").alias("total_amount"),
    )


def _json_updates(spark, d):
    """One update of each urgent document, after an older one of those with an even id."""
    last = _documents(spark, d).filter(F.col("document_type") == "2-HIGH").select(
        F.col("id").alias("document_id"), F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit("}")).alias("json_output"),
        F.lit(2).alias("seq"),
    )
    older = last.filter(F.col("document_id") % 2 == 0).withColumn("json_output", F.lit('{"z":"older"}'))
    return last.unionByName(older.withColumn("seq", F.lit(1)))


@query
def json_update(spark, d):
    return reviews.update_json(_documents(spark, d), _json_updates(spark, d))["documents"].select("id", "json_output")


@query
def json_update_audit(spark, d):
    return reviews.update_json(_documents(spark, d), _json_updates(spark, d))["audit_logs"]


@query
def upsert_latest(spark, d):
    existing = read_table(spark, d, "customer").filter(F.col("c_acctbal") > 0).select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("email"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("last_login"),
    )
    incoming = read_table(spark, d, "events").select(
        "user_id", "event_id", F.concat(F.lit("User "), F.col("event_id").cast("string")).alias("full_name"),
        F.col("event_type").alias("email"), F.col("ts").alias("created_at"), F.col("ts").alias("last_login"),
    )
    return reviews.upsert_latest(existing, incoming, "user_id", "event_id", ("full_name", "last_login"))


# --- scalar functions -------------------------------------------------------------------------------------


@query
def fold_text(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", tx.fold_text(F.col("text")).alias("folded"))
    return docs.unionByName(b.invoices(spark, d).select("doc_id", tx.fold_text(F.col("ocr_text")).alias("folded")))


@query
def fold_digits(spark, d):
    return b.invoices(spark, d).select("doc_id", tx.fold_digits(F.col("ocr_text")).alias("folded"))


def _amount_texts(spark, d):
    """Amounts in several spellings: plain, European, with currency, in Arabic digits, or no number at all."""
    price = read_table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("c"),
        (F.col("l_orderkey") % 7).alias("m"),
    )
    whole, cents = F.floor(F.col("c") / 100).cast("string"), F.lpad((F.col("c") % 100).cast("string"), 2, "0")
    grouped = F.regexp_replace(whole, r"([0-9])([0-9]{3})$", "$1,$2")
    spelled = (
        F.when(F.col("m") == 0, b.money(F.col("c")))
        .when(F.col("m") == 1, F.concat(F.replace(grouped, F.lit(","), F.lit(".")), F.lit(","), cents))
        .when(F.col("m") == 2, F.concat(F.lit("SAR "), grouped, F.lit("."), cents))
        .when(F.col("m") == 3, F.translate(F.concat(whole, F.lit("٫"), cents), "0123456789", b.ARABIC_INDIC))
        .when(F.col("m") == 4, F.concat(whole, F.lit(","), cents, F.lit("SAR")))
        .when(F.col("m") == 5, F.concat(F.lit("$ "), grouped))
        .otherwise(F.concat(F.lit("n/a "), F.col("l_linenumber").cast("string"), F.lit("-"), cents))
    )
    return price.select("l_orderkey", "l_linenumber", spelled.alias("raw"))


def _of_amounts(spark, d, name, fn):
    return _amount_texts(spark, d).select("l_orderkey", "l_linenumber", "raw", fn(F.col("raw")).alias(name))


@query
def normalize_number_str(spark, d):
    return _of_amounts(spark, d, "plain", num.normalize_number_str)


@query
def normalize_number(spark, d):
    return _of_amounts(spark, d, "number", num.normalize_number)


@query
def parse_float_amount(spark, d):
    return _of_amounts(spark, d, "number", num.parse_float_amount)


@query
def amount_candidates(spark, d):
    runs = num.amount_candidates(F.col("ocr_text"))
    return b.invoices(spark, d).select("doc_id", F.size(runs).cast("long").alias("n"), F.array_join(runs, "|").alias("runs"))


@query
def amount_grounded(spark, d):
    cents = F.floor(F.col("doc_id") * 97 % 100000) / F.lit(100.0)
    return _values(spark, d).select(
        "doc_id",
        num.amount_grounded(F.col("v_total_amount"), F.col("ocr_text")).alias("total_grounded"),
        num.amount_grounded(cents, F.col("ocr_text")).alias("other_grounded"),
    )


@query
def field_mentioned(spark, d):
    lower = F.lower("ocr_text")
    return b.invoices(spark, d).select(
        "doc_id", *(val.field_mentioned(f, lower).alias(f) for f in C.FIELDS)
    )


@query
def normalize_currency(spark, d):
    raw = F.element_at(
        F.array(*(F.lit(x) for x in ("Saudi Riyal", "ر.س", "USD", " EUR ", "", "SR", "aed"))),
        (F.col("o_orderkey") % 7 + 1).cast("int"),
    )
    return read_table(spark, d, "orders").select(
        "o_orderkey", raw.alias("raw"), cur.normalize_currency(raw).alias("currency")
    )


def _date_texts(spark, d):
    """Order dates in every accepted layout and in some that are not."""
    ts = F.col("o_orderdate")
    layouts = (
        "yyyy-MM-dd", "d-M-yyyy", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy.M.d", "d.MM.yyyy",
        "yyyy-MM-dd'T'HH:mm:ss", "yy-MM-dd", "MMM d yyyy", "yyyy-MM-dd ",
    )
    spelled = F.lit("")
    for i, layout in enumerate(layouts):
        spelled = F.when(F.col("o_orderkey") % 12 == i, F.date_format(ts, layout)).otherwise(spelled)
    return read_table(spark, d, "orders").select("o_orderkey", spelled.alias("raw"))


@query
def is_valid_date(spark, d):
    return _date_texts(spark, d).withColumn("valid", dt.is_valid_date(F.col("raw")))


@query
def normalize_date_iso(spark, d):
    return _date_texts(spark, d).withColumn("iso", dt.normalize_date_iso(F.col("raw")))


@query
def is_empty_value(spark, d):
    raw = F.element_at(
        F.array(*(F.lit(x) for x in ("", " null ", "None", "none", "0", " \t", "x"))), (F.col("event_id") % 7 + 1).cast("int")
    )
    value = F.when(F.col("event_id") % 8 == 7, F.lit(None)).otherwise(raw)
    return read_table(spark, d, "events").select("event_id", tx.is_empty_value(value).alias("is_empty"))


@query
def parse_model_json(spark, d):
    wrapped = F.element_at(
        F.array(
            F.col("raw_llm_response"),
            F.concat(F.lit("Here it is: "), F.col("raw_llm_response"), F.lit(" done.")),
            F.concat(F.lit("["), F.col("raw_llm_response"), F.lit("]")),
            F.lit("[1]"),
        ),
        (F.col("doc_id") % 4 + 1).cast("int"),
    )
    answer = js.parse_model_json(wrapped)
    return b.invoices(spark, d).select(
        "doc_id", answer.isNotNull().alias("parsed"), js.json_path_text(answer, "$.document.number").alias("number")
    )


@query
def flatten_canonical(spark, d):
    answer = F.col("answer")
    flat = [
        (canon.flat_amount if f in C.AMOUNT_FIELDS else canon.flat_text)(answer, f).alias(f) for f in C.FIELDS[:13]
    ]
    return val.with_answer(b.invoices(spark, d)).select(
        "doc_id", canon.flat_document_type(answer).alias("document_type"), *flat
    )


def _alias_records(spark, d):
    """Stored JSON in the older flat spellings."""
    text = lambda name: F.concat(F.lit('"'), F.col(name), F.lit('"'))
    o = F.col("o_orderkey")
    number = F.concat(F.lit('"INV-'), o.cast("string"), F.lit('"'))
    cents = b.money(F.round(F.col("o_totalprice") * 100).cast("long"))
    record = F.concat(
        F.lit("{"),
        F.when(o % 3 == 0, F.lit('"document":{"number":"","date":null},"invoice_number":')).otherwise(F.lit('"number":')),
        number,
        F.lit(',"vendor_name_en":" '), F.col("o_orderpriority"), F.lit(' ","invoice_date":"'),
        F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit('","financials":{"subtotal":0,"total_amount":'),
        F.when(o % 2 == 0, F.concat(F.lit('"'), cents, F.lit(' SAR"'))).otherwise(F.lit('""')),
        F.lit('},"subtotal":'), cents,
        F.lit(',"vat_amount":"'), F.col("o_custkey").cast("string"), F.lit(',50","grand_total":'), cents,
        F.lit(',"po_number":"PO'), F.col("o_custkey").cast("string"),
        F.when(o % 5 == 0, F.lit('","type":"receipt"}')).otherwise(F.lit('"}')),
    )
    return read_table(spark, d, "orders").select(o.alias("id"), record.alias("json_output"))


@query
def map_to_canonical(spark, d):
    return exports.map_to_canonical(_alias_records(spark, d), "json_output", "id")


@query
def flatten_json(spark, d):
    leaves = js.flatten_json(F.col("answer"))
    return val.with_answer(b.invoices(spark, d)).select("doc_id", F.inline(leaves))


_FLAT_PATHS = {
    "document_number": "$.document.number",
    "document_date": "$.document.date",
    "vendor_name_en": "$.vendor.name_en",
    "notes": "$.metadata.notes",
    "document_type": "$.document_type",
}


@query
def flatten_object(spark, d):
    return val.with_answer(b.invoices(spark, d)).select("doc_id", *js.flatten_object(F.col("answer"), _FLAT_PATHS))


@query
def json_path_get(spark, d):
    v = F.try_parse_json("props")
    return read_table(spark, d, "events").select(
        "event_id", js.json_path_text(v, "$.k").alias("k"), js.json_path_text(v, "$.k.deeper").alias("deeper"),
        js.json_path_text(v, "$.absent").alias("absent"),
    )


@query
def iso_day_bounds(spark, d):
    return read_table(spark, d, "events").select(
        "event_id", dt.day_start(F.col("ts")).alias("day_start"), dt.day_end(F.col("ts")).alias("next_day_start")
    )


@query
def normalize_issues(spark, d):
    raw = F.concat(
        F.lit('[{"field":"'), F.col("event_type"), F.lit('","message":"m'), F.col("event_id").cast("string"),
        F.lit('"},"text",{"severity":"error","message":"n"},'), F.col("event_id").cast("string"), F.lit("]"),
    )
    raw = F.when(F.col("event_id") % 4 == 0, F.lit('{"field":"x"}')).when(F.col("event_id") % 4 == 1, "bad").otherwise(raw)
    return read_table(spark, d, "events").select("event_id", _issues_text(js.normalize_issues(raw)).alias("issues"))


@query
def safe_basename(spark, d):
    return read_table(spark, d, "pages").select("page_id", tx.safe_basename(F.col("url")).alias("name"))


@query
def initials(spark, d):
    name = F.when(F.col("c_custkey") % 3 == 0, F.replace("c_name", F.lit("#"), F.lit(" "))).when(
        F.col("c_custkey") % 3 == 1, F.col("c_name")
    ).otherwise(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("  "), F.lower("c_name"), F.lit(" x")))
    name = F.when(F.col("c_custkey") % 10 == 9, F.lit("  ")).otherwise(name)
    return read_table(spark, d, "customer").select("c_custkey", tx.initials(name).alias("initials"))


@query
def timings_map(spark, d):
    m = js.timings_map(F.col("processing_timings"))
    return b.invoices(spark, d).select(
        "doc_id", F.size(m).cast("long").alias("n"), F.try_element_at(m, F.lit("ocr_time")).alias("ocr_time"),
        F.try_element_at(m, F.lit("extraction_time")).alias("extraction_time"),
    )


@query
def json_payload(spark, d):
    body = F.struct("event_type", F.struct("event_id", "user_id").alias("who"), F.lit("نعم").alias("note"))
    payload = F.when(F.col("event_id") % 2 == 0, js.json_payload(F.col("props"), is_text=True)).otherwise(
        js.json_payload(body, is_text=False)
    )
    return read_table(spark, d, "events").select("event_id", payload.alias("payload"))


@query
def download_json(spark, d):
    a = F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise("")
    e = F.when(F.col("event_id") % 2 == 0, F.lit('{"x":1}'))
    return read_table(spark, d, "events").select("event_id", js.download_json(a, e).alias("payload"))


@query
def display_ts(spark, d):
    return read_table(spark, d, "events").select(
        "event_id", dt.display_timestamp(F.col("ts")).alias("shown"), dt.display_day(F.col("ts")).alias("shown_day")
    )


@query
def status_slug(spark, d):
    return _documents(spark, d).select("id", tx.status_slug(F.col("status")).alias("slug"))


# --- document text ----------------------------------------------------------------------------------------


@query
def has_html(spark, d):
    pages = read_table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return pages.unionByName(docs).select("id", tx.has_html(F.col("text")).alias("has_html"))


def _strip_html(spark, d):
    return read_table(spark, d, "pages").select("page_id", strip_html(F.col("html")).alias("text"))


QUERIES["strip_html"] = _strip_html


@query
def strip_tags_simple(spark, d):
    return read_table(spark, d, "pages").select("page_id", tags_to_lines(F.col("html")).alias("text"))


@query
def clean_ocr(spark, d):
    return read_table(spark, d, "documents").select("doc_id", tx.clean_ocr(F.col("text")).alias("text"))


@query
def compress_table(spark, d):
    cleaned = assembly.clean_pages(b.doc_pages(spark, d))
    return cleaned.select("doc_id", "page_no", "compressed_body")


# --- validation, scoring, status --------------------------------------------------------------------------


@query
def unpivot_fields(spark, d):
    return val.unpivot_values(_values(spark, d))


@query
def field_state(spark, d):
    return val.unpivot_states(_checked(spark, d)).select("doc_id", "field", "state")


@query
def field_confidence(spark, d):
    return val.unpivot_states(_checked(spark, d)).select(
        "doc_id", "field", (F.col("score") / F.lit(100.0)).alias("confidence")
    )


def _indexed(spark, d):
    return val.with_text_index(_values(spark, d))


@query
def amount_grounding(spark, d):
    return _indexed(spark, d).select(
        "doc_id", *(num.amount_in(F.col(f"v_{f}"), F.col("ocr_amounts")).alias(f) for f in C.AMOUNT_FIELDS)
    )


@query
def date_grounding(spark, d):
    value = F.col("v_document_date")
    return _indexed(spark, d).select(
        "doc_id", (dt.is_valid_date(value) & val.date_grounded(value, F.col("ocr_fold"))).alias("grounded")
    )


@query
def currency_grounding(spark, d):
    grounded = val.currency_grounded(F.col("v_currency"), F.col("ocr_lower"), F.col("ocr_fold"))
    return _indexed(spark, d).select("doc_id", grounded.alias("grounded"))


@query
def text_grounding(spark, d):
    fields = [f for f in C.FIELDS[:10] if f not in ("document_date", "currency")]
    return _indexed(spark, d).select(
        "doc_id", *(val.text_grounded(F.col(f"v_{f}"), F.col("ocr_fold")).alias(f) for f in fields)
    )


@query
def math_check(spark, d):
    return _checked(spark, d).select("doc_id", "math_failed", F.col("s_total_amount").alias("total_state"))


@query
def issues(spark, d):
    return _checked(spark, d).select("doc_id", _issues_text(F.col("issues")).alias("issues"))


@query
def penalties(spark, d):
    return _checked(spark, d).select("doc_id", (F.col("penalty") / F.lit(100.0)).alias("penalty_total"))


@query
def valid_flag(spark, d):
    return _checked(spark, d).select("doc_id", "valid")


@query
def document_status(spark, d):
    return _checked(spark, d).select("doc_id", "status")


@query
def review_badge(spark, d):
    return process.review_queue(_checked(spark, d))


@query
def currency_in_place(spark, d):
    """The rewritten currency shows in both places of the stored JSON."""
    stored = F.col("stored")
    processed = process.process_documents(b.invoices(spark, d))
    return processed.withColumn("stored", js.read_object(F.col("json_output"))).select(
        "document_id", js.json_path_text(stored, "$.currency").alias("flat"),
        js.json_path_text(stored, "$.document.currency").alias("nested"),
    )


@query
def process_documents(spark, d):
    return _flat_result(process.process_documents(b.invoices(spark, d)))


def _judged_pages(spark, d, span):
    answers = b.invoices(spark, d).select("doc_id", "raw_llm_response")
    judged = pageflow.process_pages(b.invoice_pages(spark, d), answers, pages_per_segment=span)
    return judged.select("doc_id", "status", "confidence", "valid", "penalty", "text_length",
                         _issues_text(F.col("issues")).alias("issues"), _map_text(val.states_map()).alias("field_states"))


@query
def process_pages(spark, d):
    return _judged_pages(spark, d, 256)


@query
def process_pages_short_spans(spark, d):
    """Spans of three pages, so that every document has several."""
    return _judged_pages(spark, d, 3)


def _flat_result(processed: DataFrame) -> DataFrame:
    stored = F.col("stored")
    return processed.withColumn("stored", js.read_object(F.col("json_output"))).select(
        "document_id", "filename", "document_type", "status", "confidence", "extraction_engine",
        F.col("validation.valid").alias("valid"),
        _issues_text(F.col("validation.issues")).alias("issues"),
        _map_text(F.col("validation.field_states")).alias("field_states"),
        js.json_path_text(stored, "$.document_number").alias("document_number"),
        js.json_path_text(stored, "$.vendor_name_en").alias("vendor_name_en"),
        js.json_path_text(stored, "$.document.currency").alias("currency"),
        F.try_variant_get(stored, "$.total_amount", "double").alias("total_amount"),
        F.length("raw_text").cast("long").alias("text_length"),
        "page_count", "processing_time", "file_path",
        F.when(~js.is_json_number(stored, "$.financials.total_amount"),
               js.json_path_text(stored, "$.financials.total_amount")).alias("raw_total"),
        js.json_path_text(stored, "$.vendor.phone").alias("vendor_phone"),
    )


# --- rules of the staged design ---------------------------------------------------------------------------


@query
def label_extract(spark, d):
    found = rules.label_extract(F.col("ocr_text"))
    return b.invoices(spark, d).select("doc_id", *(c.alias(f) for f, c in found.items()))


@query
def reject_placeholder(spark, d):
    raw = F.element_at(
        F.array(*(F.lit(x) for x in (*C.PLACEHOLDERS, "Acme", " Client ", "customer"))),
        (F.col("event_id") % 12 + 1).cast("int"),
    )
    return read_table(spark, d, "events").select("event_id", rules.reject_placeholder(raw).alias("value"))


@query
def vat_format_ok(spark, d):
    value = F.when(F.col("doc_id") % 3 == 0, F.left("v_vat_number", (F.col("doc_id") % 16).cast("int"))).otherwise(
        F.col("v_vat_number")
    )
    return _values(spark, d).select(
        "doc_id", rules.vat_format_ok(value).alias("ok"), rules.vat_format_ksa(value).alias("ksa")
    )


@query
def currency_code(spark, d):
    docs = b.invoices(spark, d).select("doc_id", cur.currency_code(F.col("ocr_text")).alias("code"))
    texts = read_table(spark, d, "documents").select(
        "doc_id", cur.currency_code(F.concat(F.col("lang"), F.lit(" usd, "), F.col("text"))).alias("code")
    )
    return docs.unionByName(texts)


@query
def weighted_confidence(spark, d):
    merged = rules.merge_field_results(b.field_results(spark, d))
    scores = {f: F.element_at("_confidences", f) for f in C.STAGED_FIELDS}
    missing = sum((F.col(f).isNull().cast("int") for f in C.STAGED_FIELDS), F.lit(0))
    return merged.select(
        "doc_id", rules.weighted_confidence(scores).cast("long").alias("score"),
        rules.weighted_confidence(scores, warnings=missing, warning_penalty=5).cast("long").alias("score_less_penalties"),
    )


@query
def merge_field_results(spark, d):
    merged = rules.merge_field_results(b.field_results(spark, d))
    return merged.select(
        "doc_id", *C.STAGED_FIELDS, F.element_at("_evidence", "vendor_name").alias("vendor_evidence"),
        F.element_at("_confidences", "total_amount").cast("long").alias("total_score"),
    )


@query
def evidence_grounded(spark, d):
    # The text is folded once a document: beside the generator or above it, it would be folded once a field.
    folded = b.field_answers(spark, d).withColumn("fold", tx.fold_text(F.col("ocr_text")))
    results = folded.select("doc_id", "fold", F.inline(b.result_entries()))
    return results.select(
        "doc_id", "field", rules.evidence_grounded(F.col("value"), F.col("evidence"), F.col("fold")).alias("grounded")
    )


@query
def export_9col(spark, d):
    return rules_export(rules.merge_field_results(b.field_results(spark, d)))


def rules_export(merged: DataFrame) -> DataFrame:
    return exports.staged_export(merged, "doc_id")


@query
def engine_compare(spark, d):
    """Two engines' answers against the printed labels' values."""
    results = b.field_results(spark, d).withColumn("lower", F.lower("ocr_text"))
    labels = rules.label_extract(F.col("ocr_text"), F.col("lower"))
    expected = F.coalesce(*(F.when(F.col("field") == f, labels[f]) for f in C.STAGED_FIELDS)).alias("expected")
    # Labels are read once a document and field: beside the generator below they would be read once an engine.
    results = results.select("doc_id", "field", "value", expected)
    # The staged engine stands for one that leaves a thirteenth of the documents unread.
    staged = F.when(F.col("doc_id") % 13 != 0, F.col("value"))
    engines = F.array(
        F.struct(F.lit("single").alias("engine"), F.col("value")),
        F.struct(F.lit("staged").alias("engine"), staged.alias("value")),
    )
    return rules.engine_compare(results.select("field", "expected", F.inline(engines)))


@query
def with_model_response(spark, d):
    """The hook with an answer that tells how long its text is."""

    def answer(batches):
        for batch in batches:
            yield batch.assign(raw_llm_response='{"n":' + batch["ocr_text"].str.len().astype(str) + "}")[["doc_id", "raw_llm_response"]]

    return process.with_model_response(b.invoices(spark, d), answer)


@query
def sql_functions(spark, d):
    """Amounts and whole texts through the SQL functions."""
    sqlfuncs.register(spark)
    amounts = normalize_number_str(spark, d).selectExpr(
        "l_orderkey AS id", "l_linenumber AS part", "dp_normalize_number_str(raw) AS text", "dp_normalize_number(raw) AS number")
    texts = read_table(spark, d, "documents").selectExpr(
        "doc_id AS id", "0 AS part", "dp_fold_text(text) AS text", "CAST(NULL AS DOUBLE) AS number")
    return amounts.unionByName(texts)


def _through_sql(df: DataFrame, columns: str, call: str) -> DataFrame:
    """Rows of ``df`` beside what a table function makes of each."""
    sqlfuncs.register(df.sparkSession)
    return df.sparkSession.sql(f"SELECT {columns} FROM {{df}} AS d, LATERAL {call}", df=df)


@query
def sql_amounts(spark, d):
    return _through_sql(b.invoices(spark, d).select("doc_id", "ocr_text"), "doc_id, pos, run", "dp_amounts(d.ocr_text)")


@query
def sql_leaves(spark, d):
    answers = val.with_answer(b.invoices(spark, d)).select("doc_id", "answer")
    return _through_sql(answers, "doc_id, path, value", "dp_leaves(d.answer)")


@query
def sql_fields(spark, d):
    sqlfuncs.register(spark)
    answers = b.invoices(spark, d).selectExpr("doc_id", "dp_model_json(raw_llm_response) AS answer")
    return _through_sql(answers, "doc_id, position, field, value", "dp_fields(d.answer)")


# --- streams ----------------------------------------------------------------------------------------------


def _arrive(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


@query
def stream_process(spark, d):
    from docproof.streaming import jobs

    base = scratch_dir(spark)
    _arrive(b.invoices(spark, d).select(*jobs.INPUT_SCHEMA.fieldNames()), f"{base}/in")
    arrivals = jobs.read_arrivals(spark, f"{base}/in", jobs.INPUT_SCHEMA)
    jobs.process_stream(arrivals, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return jobs.read_committed(spark, f"{base}/out", "documents").select(
        "id", "filename", "status", "confidence", F.get_json_object("json_output", "$.document_number").alias("document_number")
    )


@query
def stream_dedupe(spark, d):
    from docproof.streaming import jobs

    base = scratch_dir(spark)
    # Batches of uploads as they come, their repeats within the hour, and all again a day later. The clock stands still
    # without arrivals, so one file of its own arrives between.
    started = F.lit("2024-01-01 00:00:00").cast("timestamp")
    uploads = b.uploads(spark, d).select("name", "size", "last_modified")
    second = F.pmod(F.xxhash64("name", "last_modified"), F.lit(1200))
    at = lambda rows, seconds: rows.withColumn("ts", (started.cast("long") + seconds).cast("timestamp"))
    tick = spark.range(1).select(*(F.lit(None).cast(t).alias(n) for n, t in uploads.dtypes))
    batches = (at(uploads, second), at(uploads, second + 1500), at(tick, F.lit(80_000)), at(uploads, second + 86_400))
    for batch in batches:
        _arrive(batch, f"{base}/in")
        stream = jobs.read_arrivals(spark, f"{base}/in", batch.schema)
        jobs.run_to_table(jobs.dedupe_stream(stream), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    kept = spark.read.parquet(f"{base}/out").filter("name IS NOT NULL")
    day = F.floor((F.col("ts").cast("long") - started.cast("long")) / 86_400).alias("day")
    return kept.select("name", "size", "last_modified", day)


@query
def stream_trend(spark, d):
    from docproof.streaming import jobs

    base = scratch_dir(spark)
    events = b.audit_logs(spark, d).select("id", "created_at")
    _arrive(events, f"{base}/in")
    stream = jobs.read_arrivals(spark, f"{base}/in", events.schema)
    jobs.trend_to_table(jobs.trend_stream(stream), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return jobs.read_trend(spark, f"{base}/out")


@query
def stream_tokens(spark, d):
    from docproof.streaming import jobs, tokens

    base = scratch_dir(spark)
    chunks = b.token_chunks(spark, d)
    _arrive(chunks, f"{base}/in")
    stream = jobs.read_arrivals(spark, f"{base}/in", chunks.schema)
    tokens.spans_to_table(tokens.token_stream(stream), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return tokens.stream_texts(tokens.latest_spans(spark, f"{base}/out"))
