"""Operators on small tables with known answers, including keys that hold most of the rows."""

import datetime as dtm
import json
import re

import pytest
from pyspark.sql import functions as F

from docproof import constants as C
from docproof.operators import analytics, assembly, exports, fieldrules, ordered, relations, reviews, search, validation
from docproof.operators.scoring import document_status
from docproof.plans import process
from docproof.plans.bindings import invoices
from docproof.sources import tables

# Defect class -> (confidence, status, fields whose state is not valid).
EXPECTED = {
    0: (0.98, "Approved", {}),
    1: (0.93, "Needs Review", {"total_amount": C.INCORRECT}),
    2: (0.97, "Approved", {"document_date": C.ABSENT}),
    3: (0.91, "Needs Review", {"document_date": C.MISSING}),
    4: (0.93, "Needs Review", {"document_number": C.INCORRECT}),
    5: (0.98, "Approved", {}),
    6: (0.98, "Approved", {}),
    7: (0.98, "Approved", {}),
    8: (0.10, "Needs Review", {f: C.MISSING for f in C.FIELDS[:13]}),
    9: (0.98, "Approved", {}),
    # European decimals and a currency word after the number: the strict reader takes neither.
    "6 European": (0.93, "Needs Review", {"total_amount": C.INCORRECT}),
    "6 riyal": (0.91, "Needs Review", {"total_amount": C.MISSING}),
}


def test_known_defects(spark, small):
    rows = validation.validate(invoices(spark, small)).drop("answer").collect()
    assert len(rows) > 1000
    for row in rows:
        kind = {16: "6 European", 26: "6 riyal"}.get(row["doc_id"] % 30, row["k"])
        confidence, status, wrong = EXPECTED[kind]
        assert (row["confidence"], row["status"]) == (confidence, status)
        assert row["valid"] == (kind not in (1, 4, 8, "6 European", "6 riyal"))
        for field in C.FIELDS:
            always = C.ABSENT if field in ("purchase_order", "customer_vat", "payment_terms") else C.VALID
            assert row[f"s_{field}"] == wrong.get(field, always), (row["doc_id"], field)


def one_document(spark, text, answer):
    df = spark.createDataFrame([(1, "a.pdf", text, answer, "{}")], "doc_id long, original_filename string, "
                               "ocr_text string, raw_llm_response string, processing_timings string")
    return validation.validate(df).first()


def amounts(sub, tax, total):
    return json.dumps({"financials": {"subtotal": sub, "tax_amount": tax, "total_amount": total}})


@pytest.mark.parametrize(("total", "failed"), [(1180.04, False), (1180.06, True)])
def test_math_check(spark, total, failed):
    text = f"subtotal 1000.00 tax 180.00 total {total}"
    row = one_document(spark, text, amounts(1000, 180, total))
    assert row["math_failed"] is failed
    assert row["s_total_amount"] == (C.INCORRECT if failed else C.VALID)


def test_math_check_overrides_absent_field(spark):
    row = one_document(spark, "nothing here", amounts(1, 2, 9))
    assert row["found_total_amount"] == C.ABSENT and row["s_total_amount"] == C.INCORRECT
    assert [i["severity"] for i in row["issues"]] == ["warning", "warning", "error"]
    assert row["issues"][-1]["message"] == (
        "Math check failed: subtotal (1.0) + tax (2.0) = 3.00, but total is 9.0."
    )


def test_sections_of_wrong_type_count_as_missing(spark):
    row = one_document(spark, "invoice no 7", '{"document":"x","vendor":[1],"metadata":3,"financials":null}')
    assert row["s_document_number"] == C.MISSING and row["status"] == "Needs Review"


def test_date_needs_one_group_or_all_when_strict(spark):
    df = spark.createDataFrame([("2026-06-01", "page01")], "v string, t string")
    loose = df.select(validation.date_grounded(F.col("v"), F.col("t"))).first()[0]
    strict = df.select(validation.date_grounded(F.col("v"), F.col("t"), strict=True)).first()[0]
    assert (loose, strict) == (True, False)


def test_low_confidence_is_rejected(spark):
    df = spark.createDataFrame([(0.05, False), (0.06, True), (0.97, False)], "c double, low boolean")
    assert [r[0] for r in df.select(document_status(F.col("c"), F.col("low"))).collect()] == [
        "Rejected", "Needs Review", "Approved",
    ]


def test_accuracy(spark):
    sessions = spark.createDataFrame([(1,), (2,)], "id long")
    docs = spark.createDataFrame(
        [(1, {"a": C.VALID, "b": C.ABSENT}), (1, {"a": C.VALID, "b": C.MISSING})],
        "session_id long, field_states map<string,string>",
    )
    got = {r[0]: r[1] for r in analytics.session_accuracy_of_maps(sessions, docs).collect()}
    assert got == {1: 75.0, 2: 100.0}


def test_session_name(spark):
    files = spark.createDataFrame([(1, "b", 2), (1, "a.pdf", 1), (1, "c", 3), (2, "x.pdf", 1)], "session_id long, filename string, pos long")
    got = {r[0]: r[1] for r in analytics.session_name(files).collect()}
    assert got == {1: "a.pdf and 2 other files", 2: "x.pdf"}


def islands(values, share):
    top, count, inside = max(values), 0, False
    for v in values:
        above = v > top * share
        count += above and not inside
        inside = above
    return count


def test_islands(spark):
    rows = [("z", i, i, float(v)) for i, v in enumerate([0, 0, 0])]
    rows += [("y", i, i, v) for i, v in enumerate([10.0, 0.0, 10.0, 10.0, 0.4])]
    df = spark.createDataFrame(rows, "k string, ts long, id long, v double")
    assert {r[0]: r[1] for r in ordered.island_count(df, "k", "v", "ts", "id").collect()} == {"z": 0, "y": 2}


def test_islands_of_a_key_that_holds_most_rows(spark):
    """The hot key is cut into many ranges; runs that cross a cut are counted once."""
    hot = [float((i * 7919) % 101) for i in range(20000)]
    small_keys = {f"k{j}": [float((i * j) % 13) for i in range(40)] for j in range(1, 50)}
    rows = [("hot", i, i, v) for i, v in enumerate(hot)]
    rows += [(k, i, i, v) for k, vs in small_keys.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "k string, ts long, id long, v double").repartition(7)
    got = {r[0]: r[1] for r in ordered.island_count(df, "k", "v", "ts", "id", share=0.5).collect()}
    assert got == {k: islands(vs, 0.5) for k, vs in {"hot": hot, **small_keys}.items()}
    cuts = ordered.with_ranges(df, "k", "ts", "id").filter("k = 'hot'").select("range_id").distinct().count()
    assert cuts > 1


def page(doc, no, body, total=0, head="h", foot="f"):
    return (doc, no, f"{head}{no}", body, f"{foot}{no}", 1, 10, 100, "stop", "stop", "stop", total)


PAGE_SCHEMA = (
    "doc_id long, page_no long, header_text string, body_text string, footer_text string, h_tokens long, b_tokens long,"
    " f_tokens long, h_reason string, b_reason string, f_reason string, total_lines long"
)


def whole_text(df):
    parts = {}
    for r in df.orderBy("doc_id", "segment").collect():
        parts.setdefault(r["doc_id"], []).append(r["text"])
    return {k: "\n".join(v) for k, v in parts.items()}


def test_document_text(spark):
    rows = [page(1, 3, " "), page(1, 1, ""), page(1, 2, "b2"), page(2, 5, "\n"), page(3, 1, "x"), page(3, 2, ""), page(3, 3, "y")]
    df = spark.createDataFrame(rows, PAGE_SCHEMA)
    rulers = [C.SECTION_RULER.format(s) for s in ("HEADER", "BODY", "FOOTER")]
    build = lambda h, b, f: "\n".join((rulers[0], h, rulers[1], b, rulers[2], f))
    want = {1: build("h1", "b2", "f3"), 2: build("h5", "", "f5"), 3: build("h1", "x\n\ny", "f3")}
    assert whole_text(assembly.assemble_document_text(df)) == want
    assert whole_text(assembly.assemble_document_text(df, pages_per_segment=1)) == want
    lengths = {r["doc_id"]: r for r in assembly.ocr_telemetry(df).collect()}
    assert {k: r["compressed_length"] for k, r in lengths.items()} == {k: len(v) for k, v in want.items()}
    assert lengths[1]["tokens"] == 1 + 30 + 100


def test_long_document_is_cut_into_segments(spark):
    rows = [page(1, i, f"p{i}") for i in range(1000)] + [page(2, 1, "only")]
    out = assembly.assemble_document_text(spark.createDataFrame(rows, PAGE_SCHEMA), pages_per_segment=64)
    assert out.filter("doc_id = 1").count() == 16
    body = whole_text(out)[1].split("\n")
    assert body[3:1003] == [f"p{i}" for i in range(1000)]


def chunk(req, seq, content="", done=False, **more):
    return (req, seq, json.dumps({"message": {"content": content}, "done": done, **more}))


def test_token_stream(spark):
    rows = [chunk(1, 0, " "), chunk(1, 2, "b "), chunk(1, 1, "a"), chunk(1, 3, " "), (1, 4, "{broken"), (1, 5, "[1]"),
            chunk(1, 6, done=True, done_reason="length"), chunk(2, 0, "x"), chunk(2, 1, done=True, eval_count=9)]
    df = spark.createDataFrame(rows, "req_id long, seq long, line string")
    for span in (1, 2, 100):
        parts = assembly.assemble_token_stream(df, span).orderBy("req_id", "segment").collect()
        for req, text, tokens, reason in ((1, "ab", 4, "length"), (2, "x", 9, "stop")):
            mine = [p for p in parts if p["req_id"] == req]
            assert "".join(p["text"] for p in mine) == text
            assert {(p["tokens"], p["done_reason"]) for p in mine} == {(tokens, reason)}


def test_token_stream_is_cleaned_over_span_cuts(spark):
    """Tags, references, comments, blanks and repeated lines that run over cuts, and spans without text."""
    texts = ["<html><body><p>One  line</p><p>same</p><p>same</p><table><tr><td>A &amp; B</td></tr></table></body></html>",
             "<p>x</p><script>if (a < b) { c(); }</script><!-- a > b -->tail", "a   b\nsame\n same \nsame\n\n\n end  ",
             "plain < text &amp; more", "<p></p>", "  \n " * 4, "<p>\u00fc\U0001f600 \u0633</p> " * 6]
    rows = [chunk(r, i, t[2 * i : 2 * i + 2]) for r, t in enumerate(texts) for i in range((len(t) + 1) // 2)]
    df = spark.createDataFrame(rows, "req_id long, seq long, line string")
    joined = lambda span: whole_answers(assembly.assemble_token_stream(df, span))
    want = joined(10**6)
    assert "<" not in want[0] and want[0].count("same") == 1 and want[2] == "a b\nsame\n\nend"
    for span in (1, 3, 16):
        assert joined(span) == want


def whole_answers(df):
    parts = {}
    for r in df.orderBy("req_id", "segment").collect():
        parts.setdefault(r["req_id"], []).append(r["text"])
    return {k: "".join(v) for k, v in parts.items()}


def stored_document(spark, doc_id, extracted):
    return spark.createDataFrame(
        [(doc_id, 5, "a.pdf", json.dumps(extracted), "{}", '{"valid":true}', "Approved", 0.9, "invoice")],
        "id long, session_id long, original_filename string, extracted_json string, json_output string, "
        "validation_result string, status string, confidence double, document_type string",
    )


def edit(spark, rows):
    return spark.createDataFrame(rows, "document_id long, seq long, status string, fields map<string,string>")


def test_review_leaves_nested_amounts(spark):
    docs = stored_document(spark, 1, {"total_amount": 1.0, "financials": {"total_amount": 1.0, "extra": [1]}, "z": None})
    edits = edit(spark, [(1, 1, "Approved", {"total_amount": "1,200.00", "vendor_name": "V"})])
    row = reviews.apply_review(docs, edits).first()
    new = json.loads(row["extracted_json"])
    assert new == {"total_amount": 1200, "financials": {"total_amount": 1, "extra": [1]}, "z": None,
                   "vendor_name": "V", "vendor": {"name_en": "V"}}
    assert row["json_output"] == row["extracted_json"] and row["confidence"] == 1.0
    exported = exports.export_session_rows(reviews.apply_review(docs, edits)).first()
    assert exported["Total"] == 1.0
    strict = json.loads(reviews.apply_review(docs, edits, strict=True).first()["extracted_json"])
    assert strict["financials"]["total_amount"] == 1200


def test_review_edits_add_up_but_the_last_decides(spark):
    docs = stored_document(spark, 1, {"currency": "SAR"}).unionByName(stored_document(spark, 2, {"currency": "SAR"}))
    edits = edit(spark, [(1, 1, "Approved", {"currency": "USD", "document_number": "A"}),
                         (1, 2, None, {"document_number": "B"}), (1, 3, "Rejected", {})])
    rows = {r["id"]: r for r in reviews.apply_review(docs, edits).collect()}
    new, check = json.loads(rows[1]["extracted_json"]), json.loads(rows[1]["validation_result"])
    assert new["document"] == {"currency": "USD", "number": "B"} and new["currency"] == "USD"
    assert rows[1]["status"] == "Rejected" and rows[1]["confidence"] == 1.0
    assert check == {"valid": False, "issues": [], "field_states": {}, "field_confidences": {}}
    assert not rows[2]["reviewed"] and json.loads(rows[2]["extracted_json"]) == {"currency": "SAR"}
    assert rows[2]["confidence"] == 0.9


def documents(spark, n):
    start = dtm.datetime(2026, 1, 1)
    rows = [(i, f"f{i}.pdf", "invoice", "Approved", 0.5, start + dtm.timedelta(minutes=i), "{}", "{}") for i in range(n)]
    return spark.createDataFrame(
        rows, "id long, filename string, document_type string, status string, confidence double, created_at timestamp_ntz,"
        " extracted_json string, json_output string"
    ).withColumn("original_filename", F.col("filename"))


def test_export_cut_comes_before_the_id_filter(spark):
    docs = documents(spark, 1500)
    oldest = docs.filter("id < 10").select("id")
    assert search.select_ids(docs, oldest).count() == 10
    assert search.select_ids(docs, oldest, limit=1000).count() == 0


def test_pages_follow_each_other(spark):
    docs = documents(spark, 40)
    first = [r["id"] for r in search.page_documents(docs, 1).collect()]
    second = [r["id"] for r in search.page_documents(docs, 2).collect()]
    last = docs.filter(F.col("id") == first[-1]).first()
    after = search.page_after(docs, F.lit(last["created_at"]), last["id"])
    assert first == list(range(39, 27, -1)) and [r["id"] for r in after.collect()] == second


def test_search_wildcards_and_dates(spark):
    docs = documents(spark, 2000)
    assert search.search_documents(docs, search=" F1_.PDF ").count() == 10
    assert search.search_documents(docs, search="\\").count() == 0
    assert search.search_documents(docs, date_from="2026-01-02", date_to="2026-01-02").count() == 2000 - 1440
    assert search.search_documents(docs, search="", status="", document_type=None).count() == 2000


def test_children_of_a_document_that_holds_most_rows(spark):
    docs = documents(spark, 3)
    logs = spark.range(5000).select(
        F.col("id"), F.when(F.col("id") % 10 == 0, 1).otherwise(0).cast("long").alias("document_id"),
        F.lit("e").alias("event_type"), F.lit("e").alias("engine"), F.lit("e").alias("action"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
    )
    none = logs.filter("id < 0")
    out = relations.document_with_children(docs, none, none, logs)
    counts = {(r["id"], r["kind"]): r["count"] for r in out.groupBy("id", "kind").count().collect()}
    assert counts == {(0, "audit_log"): 4500, (1, "audit_log"): 500, (2, None): 1}


def test_long_document_spreads_over_tasks(spark):
    """The last shuffle is by document and segment, and the segments of a hot document are all there."""
    rows = spark.range(4000).select(
        F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("doc_id"), F.col("id").alias("page_no"),
        *(F.lit("t").alias(f"{p}_text") for p in ("header", "body", "footer")), F.lit(1).alias("total_lines"),
    )
    out = assembly.assemble_document_text(rows, pages_per_segment=50)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(doc_id#\d+L?, segment#\d+L?", plan)
    hot = out.filter("doc_id = 1")
    assert hot.count() == 60 and out.count() == 60 + 1000
    assert out.select(F.sum(F.size(F.split("text", "\n")))).first()[0] == 1001 * 5 + 1000 + 3000


def test_session_exports(spark, small, tmp_path):
    rows = spark.range(300).select((F.col("id") % 3).alias("session_id"), F.col("id").alias("n"))
    exports.write_session_exports(rows, str(tmp_path / "whole"))
    back = spark.read.parquet(str(tmp_path / "whole")).withColumn("file", F.input_file_name())
    assert back.count() == 300 and back.groupBy("session_id").agg(F.countDistinct("file").alias("n")).filter("n > 1").count() == 0
    exports.write_session_exports(rows, str(tmp_path / "out"), folders=True)
    assert sorted(p.name for p in (tmp_path / "out").glob("session_id=*")) == [f"session_id={i}" for i in range(3)]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 300
    named = spark.createDataFrame([(1, 1), (2, 5)], "session_id long, n long").select(
        exports.export_name(F.col("session_id"), F.col("n"))
    )
    assert [r[0] for r in named.collect()] == ["invoice", "combined_export_2"]


def test_sources(spark, tmp_path):
    (tmp_path / "files" / "sub").mkdir(parents=True)
    for name in ("a.PDF", "sub/b.docx", "c.jpeg"):
        (tmp_path / "files" / name).write_bytes(b"xyz")
    listed = tables.list_files(spark, str(tmp_path / "files"))
    manifest = tables.ingest_manifest(listed, F.col("path"), C.UPLOAD_SUFFIXES)
    assert {(r["filename"], r["accepted"], r["length"]) for r in manifest.collect()} == {
        ("a.PDF", True, 3), ("b.docx", False, 3), ("c.jpeg", True, 3),
    }
    old = spark.createDataFrame([(1, "{}")], "id long, json_output string")
    new = spark.createDataFrame([(2, "{}", "text")], "id long, json_output string, ocr_text string")
    old.write.parquet(str(tmp_path / "docs" / "p=1"))
    new.write.parquet(str(tmp_path / "docs" / "p=2"))
    read = {r["id"]: r for r in tables.read_documents(spark, str(tmp_path / "docs")).collect()}
    assert read[1]["ocr_text"] == "" and read[2]["ocr_text"] == "text" and read[1]["processing_timings"] == "{}"


def test_checkpoint_uses_the_shared_folder(spark):
    from docproof.session import checkpoint

    df = spark.range(10).filter("id > 3")
    assert checkpoint(df).count() == 6
    folder = spark.sparkContext.getCheckpointDir()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    assert folder and (shared is None or shared in folder)


def test_confidence_summary_is_small(spark):
    row = analytics.confidence_summary(documents(spark, 100)).first()
    assert row["quantiles"] == [0.5] * 5 and len(row["histogram"]) <= 20


def test_flatten_open_json(spark):
    from docproof.functions.jsonio import flatten_json

    raw = '{"a":{"b":{"c":1,"d":[1,{"x":2}]}},"e":null,"f":"t}{[","g":{},"h":{"i":{"j":{"k":{"l":{"m":{"n":"deep"}}}}}}}'
    rows = spark.createDataFrame([(raw,), (None,)], "j string").select(F.inline(flatten_json(F.parse_json("j")))).collect()
    assert {r["path"]: r["value"] for r in rows} == {
        "a.b.c": "1", "a.b.d": '[1,{"x":2}]', "e": None, "f": "t}{[", "h.i.j.k.l.m.n": "deep"}


def test_seed_and_backfill(spark):
    docs = documents(spark, 2)
    assert tables.seed_if_empty(docs).count() == 2
    seeded = tables.demo_if_empty(docs.filter("id < 0"))
    assert {k: v.count() for k, v in seeded.items()} == {"documents": 1, "extractions": 1, "reviews": 1, "audit_logs": 1}
    old = spark.createDataFrame([("", '{"a":1}'), ("{}", "b"), ("c", "d")], "extracted_json string, json_output string")
    filled = tables.schema_backfill(old)
    assert [r["extracted_json"] for r in filled.collect()] == ['{"a":1}', "b", "c"]
    assert set(tables.ADDED_COLUMNS) <= set(filled.columns)


def test_upsert_keeps_creation_and_last_arrival_wins(spark):
    old = spark.createDataFrame([(1, "A", "c1", "l1"), (2, "B", "c2", "l2")], "k long, name string, created string, login string")
    new = spark.createDataFrame(
        [(1, 1, "X", "n", "l3"), (1, 2, "Y", "n", "l4"), (3, 1, "N", "c3", "l5")],
        "k long, seq long, name string, created string, login string",
    )
    out = reviews.upsert_latest(old, new, "k", "seq", ("name", "login"))
    assert {tuple(r) for r in out.collect()} == {(1, "Y", "c1", "l4"), (2, "B", "c2", "l2"), (3, "N", "c3", "l5")}


def test_merge_keeps_the_best_answer(spark):
    rows = [(1, "currency", "SAR", "e1", 50), (1, "currency", "USD", "e2", 90), (1, "subtotal", None, None, 0)]
    out = fieldrules.merge_field_results(
        spark.createDataFrame(rows, "doc_id long, field string, value string, evidence string, score int")
    ).first()
    assert out["currency"] == "USD" and out["_evidence"]["currency"] == "e2" and out["total_amount"] is None


def test_model_hook(spark):
    docs = spark.createDataFrame([(1, "total 5")], "doc_id long, ocr_text string")

    def answer(batches):
        for b in batches:
            yield b.assign(raw_llm_response='{"financials":{"total_amount":5}}')[["doc_id", "raw_llm_response"]]

    answers = process.with_model_response(docs, answer)
    row = validation.validate(docs.join(answers, "doc_id")).first()
    assert row["s_total_amount"] == C.VALID


def test_csv_and_json_keep_nulls_and_blanks(spark, tmp_path):
    from docproof.plans.queries import scratch_dir  # noqa: F401 - the folder rule is shared

    rows = spark.createDataFrame([(1, 'a "q", b', None), (2, "", 0.0)], "id long, `Vendor Name (Arabic)` string, Total double")
    exports.write_csv(rows, str(tmp_path / "c"))
    lines = sorted(p.read_text() for p in (tmp_path / "c").glob("*.csv"))
    assert "".join(lines).count("id,Vendor Name (Arabic),Total") >= 1
    assert '1,"a ""q"", b",' in "".join(lines) and "2,,0.0" in "".join(lines)
    exports.write_json(rows, str(tmp_path / "j"))
    records = [json.loads(l) for p in (tmp_path / "j").glob("*.json") for l in p.read_text().splitlines()]
    assert {"id": 1, "Vendor Name (Arabic)": 'a "q", b', "Total": None} in records


def test_json_values_that_count_as_absent(spark):
    from docproof.functions import canonical as canon

    given = {
        "null": (False, ""), "false": (False, ""), "true": (True, "True"), "0": (False, ""), "-0.0": (False, ""), "0E5": (False, ""),
        "1E-30": (True, None), "7": (True, "7"), '""': (False, ""), '"0"': (True, "0"), '"true"': (True, "true"), '"false"': (True, "false"),
        '"{}"': (True, "{}"), '"[]"': (True, "[]"), "{}": (False, ""), "[]": (False, ""), "[0]": (True, "[0]"), '" x "': (True, "x"),
    }
    rows = [(j, '{"document":{"number":%s}}' % j) for j in given] + [("none", "{}")]
    df = spark.createDataFrame(rows, "j string, t string").withColumn("v", F.parse_json("t"))
    path = "$.document.number"
    found = df.select("j", canon.is_truthy(F.col("v"), path).alias("is"), canon.canonical_text(F.col("v"), "document_number").alias("text"))
    for r in found.collect():
        present, text = given.get(r["j"], (False, ""))
        assert r["is"] == present
        assert text is None or r["text"] == text


def test_amounts_in_long_runs_of_separators(spark):
    from docproof.functions import numbers as num

    rows = [("." * 300_000 + " a",), (".,.5 1,5 ..,12.25a7,",)]
    found = spark.createDataFrame(rows, "t string").select(F.array_sort(num.text_amounts(F.col("t"))).alias("a")).collect()
    assert found[0]["a"] == []
    assert found[1]["a"] == [7.0]
