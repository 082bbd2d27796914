"""The shape of the physical plans."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from docproof import constants as C
from docproof.functions import canonical as canon
from docproof.operators import exports, relations, search, validation
from docproof.plans import bindings, process
from docproof.plans.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("inv"))
    bindings.invoices(spark, small).write.mode("overwrite").parquet(path)
    return path


def test_main_job_has_no_shuffle_and_no_python(spark, stored):
    text = plan(process.process_documents(spark.read.parquet(stored)))
    assert "Exchange" not in text and "Python" not in text and "Arrow" not in text


def test_filter_on_status_neither_repeats_the_checks_nor_reads_more(spark, stored):
    df = process.process_documents(spark.read.parquet(stored)).filter("status = 'Needs Review'")
    text = plan(df.select("document_id", "status"))
    assert len(text) < 200_000
    assert re.search(r"ReadSchema: struct<doc_id:bigint,ocr_text:string,raw_llm_response:string>", text)


def test_search_is_pushed_to_the_scan(spark, stored):
    docs = spark.read.parquet(stored).select(F.col("doc_id").alias("id"), "created_at", F.col("original_filename").alias("status"))
    found = search.filter_date_range(search.search_documents(docs, status="x"), "1997-01-01", "1997-02-01")
    printed = io.StringIO()
    with contextlib.redirect_stdout(printed):
        found.explain("formatted")
    text = printed.getvalue()
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text).group(1)
    assert "EqualTo(original_filename,x)" in pushed and "GreaterThanOrEqual(created_at" in pushed
    assert "LessThan(created_at" in pushed
    assert "ocr_text" not in text


def test_paging_is_a_top_k(spark, stored):
    docs = spark.read.parquet(stored).select(F.col("doc_id").alias("id"), "created_at")
    assert "TakeOrderedAndProject" in plan(search.newest(docs, 1000))
    assert "TakeOrderedAndProject" in plan(search.page_after(docs, F.lit("1997-01-01").cast("timestamp_ntz"), 5))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {n for n in QUERIES if n.startswith("stream_")}))
def test_no_query_multiplies_rows_without_a_key(spark, small, name):
    if name in ("csv_sink", "json_sink", "session_export_files"):
        pytest.skip("runs a write to build its result")
    text = plan(QUERIES[name](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("text", ["INV-1", " inv-12 ", "Pdf", "a.p", "المورد", "o_3", "%", "p", "", "no such text", "\\", "voice_1"])
def test_indexed_search_finds_the_same(spark, text):
    names = ["invoice_1.pdf", "INV-12 Überweisung.PDF", "a.p", "المورد ٣", "o_3", "back\\slash", "", None, "x" * 5000]
    docs = spark.createDataFrame([(i, n, names[-1 - i], f'{{"n":"INV-{i}"}}', None) for i, n in enumerate(names)],
                                 "id long, filename string, original_filename string, extracted_json string, json_output string")
    postings = search.text_postings(docs)
    assert postings.count() == postings.distinct().count()
    ids = lambda df: sorted(r["id"] for r in df.select("id").collect())
    assert ids(search.search_indexed(docs, postings, text)) == ids(docs.filter(search.matches_text(text)))


def test_indexed_search_reads_few_grams(spark, tmp_path):
    docs = spark.createDataFrame([(1, "abcd", "b", "c", "d")], "id long, " + ", ".join(f"{c} string" for c in search.SEARCH_COLUMNS))
    search.text_postings(docs).write.parquet(f"{tmp_path}/p")
    text = plan(search.search_indexed(docs, spark.read.parquet(f"{tmp_path}/p"), "abcd"))
    assert re.search(r"PushedFilters: \[.*In\(gram, \[abc,bcd\]\)", text) and "Python" not in text


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("sort", ["status", "created_at", "unknown"])
def test_ranked_pages_equal_offset_pages(spark, tmp_path, sort, descending):
    docs = spark.range(500).select(
        "id", F.expr("if(id % 7 = 0, null, if(id % 3 > 0, 'same', concat('s', id % 11)))").alias("status"),
        F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, id % 20)").alias("created_at"),
    )
    search.write_ranked(docs, f"{tmp_path}/r", sort, descending, ranges=9)
    for page in (1, 2, 21, 41, 42, 43, 99):
        got = search.page_ranked(spark, f"{tmp_path}/r", page, 12, sort, descending).collect()
        assert got == search.page_documents(docs, page, 12, sort, descending).collect(), page
    text = plan(search.page_ranked(spark, f"{tmp_path}/r", 30, 12, sort, descending))
    ranges = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", text).group(1)
    assert "rank_range" in ranges and len(set(re.findall(r"\b\d+\b", ranges.split("IN")[-1]))) <= 2
    search.write_ranked(docs.limit(0), f"{tmp_path}/none", sort, descending)
    assert search.page_ranked(spark, f"{tmp_path}/none", 1, 12, sort, descending).count() == 0


def test_deletes_scan_each_table_once(spark, tmp_path):
    def stored(name, df):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    sessions = stored("sessions", spark.range(10).select("id", (F.col("id") % 2 == 0).alias("old")))
    docs = stored("documents", spark.range(100).select("id", (F.col("id") % 10).alias("session_id")))
    children = {n: stored(n, spark.range(300).select("id", (F.col("id") % 120).alias("document_id"))) for n in ("a", "b")}
    left = relations.delete_sessions(sessions, docs, sessions.filter("old"), children)
    assert all(plan(t).count("FileScan") == 1 for t in left.values())
    assert {n: t.count() for n, t in left.items()} == {"sessions": 5, "documents": 50, "a": 170, "b": 170}
    left = relations.delete_documents(docs, docs.filter("id < 30"), children)
    assert all(plan(t).count("FileScan") == 1 for t in left.values())
    assert left["documents"].count() == 70


def test_export_fields_are_not_looked_up_in_lambda_functions(spark):
    """Lambda functions are interpreted row by row."""
    answers = spark.range(1).select(F.parse_json(F.lit("{}")).alias("v"))
    texts = [canon.canonical_text(F.col("v"), f).alias(f) for f in C.CANONICAL_FIELDS if f not in C.AMOUNT_FIELDS]
    for df in (answers.select(*texts), answers.select(canon.is_truthy(F.col("v"), "$.a"), canon.flat_document_type(F.col("v")))):
        assert "lambda" not in df._jdf.queryExecution().analyzed().toString()


def test_fields_of_an_answer_are_found_in_one_walk(spark):
    """Each lookup by path walks the answer anew; the values are those found at their paths."""
    leaves = ['""', '"x "', "null", "true", "0", "1.50", "12", '"1,5"', "{}", "[]", '{"number":"q"}', '[{"number":"q"}]']
    answers = ['{"document":' + v + "}" for v in leaves] + [
        f'{{"document":{{"number":{v},"date":{v}}},"financials":{{"subtotal":{v}}},"number":{v},"vat":{v}}}' for v in leaves
    ]
    df = spark.createDataFrame([(a,) for a in [*answers, None]], "j string").select(F.try_parse_json("j").alias("answer"))
    valued = validation.with_field_values(df)
    assert "$.document" not in plan(valued.drop("answer"))
    shown = [f for f in C.FIELDS if f in ("purchase_order", "customer_vat", "payment_terms")]
    paths = {f: C.FIELD_PATHS[f] for f in (*shown, "subtotal", "document_number")}
    for row in valued.select(
        *(F.col(f"v_{f}").alias(f) for f in paths),
        *(F.try_variant_get("answer", p, "string").alias(f"at_{f}") for f, p in paths.items()),
        canon.flat_amount(F.col("answer"), "subtotal").alias("amount"),
    ).collect():
        assert all(row[f] == row[f"at_{f}"] for f in shown)
        assert row["document_number"] == (row["at_document_number"] or "").strip() and row["subtotal"] == row["amount"]
    texts = df.withColumn("texts", canon.canonical_texts(F.col("answer")))
    one_walk = texts.select(*canon.canonical_columns(F.col("answer"), F.col("texts"))).collect()
    assert one_walk == df.select(*canon.canonical_columns(F.col("answer"))).collect()


def test_export_texts_are_found_in_one_walk(spark):
    stored = spark.range(1).select("id", F.lit('{"number":"7"}').alias("json_output"))
    exported = exports.export_rows(stored, "id")
    assert not re.search(r"try_variant_get\(stored[^,]*, \$\.[a-z_.]+, StringType", plan(exported))
    assert exported.first()["Invoice Number"] == "7"


def test_labels_are_read_once_for_all_engines(spark, small):
    """What stands beside a generator is worked out for each of its rows."""
    above = plan(QUERIES["engine_compare"](spark, small)).split("Generate")[0]
    assert "regexp_extract" not in above


def test_texts_are_folded_once_for_all_fields(spark, small):
    above = plan(QUERIES["evidence_grounded"](spark, small)).split("Generate")[0]
    assert "ocr_text" not in above and "fold#" in above
