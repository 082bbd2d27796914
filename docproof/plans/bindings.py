"""Document tables derived from the supplied data set.

Each function maps plain business tables onto one input of the engine. Amounts are integer cents throughout, so
every engine that runs the same formulas gets the same text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docproof.sources.tables import read_table

ARABIC_INDIC = "٠١٢٣٤٥٦٧٨٩"


def money(cents: Column) -> Column:
    whole = F.floor(cents / 100).cast("string")
    return F.concat(whole, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def _text(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def invoices(spark: SparkSession, folder: str) -> DataFrame:
    """One invoice per order with lines, with a known defect chosen by the last digit of its id."""
    lines = (
        read_table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("sub_c"),
            F.min("l_suppkey").alias("s_suppkey"),
            F.count(F.lit(1)).alias("n_lines"),
        )
    )
    customers = read_table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey")
    suppliers = read_table(spark, folder, "supplier").select("s_suppkey", "s_name")
    nations = read_table(spark, folder, "nation").select("n_nationkey", "n_name")
    base = (
        read_table(spark, folder, "orders")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(suppliers, "s_suppkey")
        .select(
            F.col("o_orderkey").alias("doc_id"),
            F.col("o_custkey").alias("session_id"),
            F.col("o_orderdate").alias("created_at"),
            (F.col("o_orderkey") % 10).cast("int").alias("k"),
            "sub_c",
            F.floor(F.col("sub_c") * 15 / 100).alias("tax_c"),
            "n_lines",
            "s_suppkey",
            "s_name",
            "c_name",
            "c_nationkey",
            "n_name",
        )
    )
    k, doc = F.col("k"), F.col("doc_id")
    day = F.date_format("created_at", "yyyy-MM-dd")
    total = F.col("sub_c") + F.col("tax_c") + F.when(k == 1, 500).otherwise(0)
    vat_no = F.concat(F.lit("3"), F.lpad(_text("s_suppkey"), 14, "0"))
    number = F.concat(F.lit("INV-"), _text("doc_id"))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Vendor: "), "s_name"),
        F.concat(F.lit("المورد "), _text("s_suppkey")),
        F.concat(F.lit("Invoice No: "), number),
        F.concat(F.lit("VAT No: "), vat_no),
        F.concat(F.lit("Customer: "), "c_name"),
        F.concat(F.lit("العميل "), _text("session_id")),
        F.concat(F.lit("Address: "), "n_name"),
        F.concat(F.lit("حي "), _text("c_nationkey")),
        F.when(k != 2, F.concat(F.lit("Date: "), day)),
        F.concat(F.lit("Subtotal: "), money(F.col("sub_c")), F.lit(" SAR")),
        F.concat(F.lit("VAT: "), money(F.col("tax_c"))),
        F.concat(F.lit("Total: "), money(total)),
    )
    answer = F.concat(
        F.lit('{"document_type":"invoice","document":{"number":"'),
        F.when(k == 4, F.concat(F.lit("INV-X"), _text("doc_id"))).otherwise(number),
        F.lit('","date":"'),
        F.when(k.isin(2, 3), "").otherwise(day),
        F.lit('","currency":"'),
        F.when(k == 9, "Saudi Riyal").otherwise("SAR"),
        F.lit('"},"vendor":{"name_ar":"المورد '),
        _text("s_suppkey"),
        F.lit('","name_en":"'),
        "s_name",
        F.lit('","vat_number":"'),
        vat_no,
        F.lit('","address_ar":"حي '),
        _text("c_nationkey"),
        F.lit('","phone":"05'),
        _text("s_suppkey"),
        F.lit('","address_en":"'),
        "n_name",
        F.lit('"},"customer":{"name_ar":"العميل '),
        _text("session_id"),
        F.lit('","name_en":"'),
        "c_name",
        F.lit('","address_ar":"","address_en":""},"financials":{"subtotal":'),
        money(F.col("sub_c")),
        F.lit(',"tax_amount":'),
        money(F.col("tax_c")),
        F.lit(',"total_amount":'),
        F.when(doc % 30 == 6, F.concat(F.lit('"SAR '), money(total), F.lit('"')))
        .when(doc % 30 == 16, F.concat(F.lit('"'), F.replace(money(total), F.lit("."), F.lit(",")), F.lit('"')))
        .when(doc % 30 == 26, F.concat(F.lit('"'), money(total), F.lit(' ريال"')))
        .otherwise(money(total)),
        F.lit('},"metadata":{"purchase_order":"","reference_number":"","payment_terms":"","notes":""'),
        F.when(k == 3, F.lit(',"extra":{"b":{"c":{"d":{"e":{"f":{"g":"deep"}}}}}}')).otherwise(""),
        F.lit("}}"),
    )
    extension = F.when(doc % 9 == 8, "docx").when(doc % 2 == 0, "PDF").otherwise("png")
    return base.select(
        "doc_id",
        "session_id",
        "created_at",
        "k",
        "n_lines",
        F.concat(F.lit("invoice_"), _text("doc_id"), F.lit("."), extension).alias("original_filename"),
        F.concat(F.lit("uploads/"), _text("doc_id")).alias("file_path"),
        (F.col("n_lines") % 3 + 1).cast("int").alias("page_count"),
        F.when(k == 5, F.translate(text, "0123456789", ARABIC_INDIC)).otherwise(text).alias("ocr_text"),
        F.when(k == 8, "not json")
        .when(k == 7, F.concat(F.lit("```json\n"), answer, F.lit("\n```")))
        .otherwise(answer)
        .alias("raw_llm_response"),
        F.when(k == 8, "not json")
        .otherwise(
            F.concat(
                F.lit('{"ocr_time":'),
                money(doc % 977 + 10),
                F.lit(',"extraction_time":'),
                money(doc % 499 + 100),
                F.lit(',"validation_time":0.0'),
                _text(doc % 7),
                F.lit("}"),
            )
        )
        .alias("processing_timings"),
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Stored documents: one per order, the customer being the upload session."""
    customers = read_table(spark, folder, "customer").select("c_custkey", "c_name")
    orders = read_table(spark, folder, "orders")
    status = (
        F.when(F.col("o_orderstatus") == "F", "Approved")
        .when(F.col("o_orderstatus") == "O", "Needs Review")
        .otherwise("Rejected")
    )
    name = F.concat(F.lit("invoice_"), _text("o_orderkey"), F.lit(".pdf"))
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("session_id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderpriority").alias("document_type"),
        status.alias("status"),
        ((F.col("o_orderkey") % 101) / F.lit(100.0)).alias("confidence"),
        name.alias("filename"),
        name.alias("original_filename"),
        F.concat(F.lit('{"customer":"'), "c_name", F.lit('"}')).alias("json_output"),
        F.lit("{}").alias("extracted_json"),
        F.lit("").alias("excel_file_path"),
    )


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Upload sessions: one per customer, created with its newest order."""
    newest = (
        read_table(spark, folder, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("created_at"))
    )
    customers = read_table(spark, folder, "customer").select("c_custkey", "c_name")
    return customers.join(newest, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.lit("").alias("excel_file_path"),
        "created_at",
    )


def audit_logs(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("document_id"),
        F.lit("system").alias("actor"),
        "event_type",
        F.col("props").alias("payload"),
        F.col("ts").alias("created_at"),
    )


def extractions(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "lineitem").select(
        F.col("l_linenumber").cast("long").alias("id"),
        F.col("l_orderkey").alias("document_id"),
        F.col("l_discount").alias("confidence"),
        F.col("l_returnflag").alias("engine"),
        F.col("l_shipdate").alias("created_at"),
    )


def review_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Reviewer edits of every invoice: corrections on ids divisible by 7, then a rejection on those by 11."""
    # Every order with lines is an invoice.
    lines = read_table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("doc_id"))
    inv = read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id")).join(lines, "doc_id", "left_semi")
    doc = F.col("doc_id")
    fields = F.create_map(
        F.lit("total_amount"),
        F.concat(F.lit("1,"), F.lpad(_text(doc % 1000), 3, "0"), F.lit(".50")),
        F.lit("document_number"),
        F.concat(F.lit("FIX-"), _text("doc_id")),
        F.lit("vendor_name_en"),
        F.lit("Corrected Vendor"),
        F.lit("currency"),
        F.lit("USD"),
    )
    corrections = inv.filter(doc % 7 == 0).select(
        doc.alias("document_id"), F.lit(1).cast("long").alias("seq"), F.lit("Approved").alias("status"),
        fields.alias("fields"),
    )
    rejections = inv.filter(doc % 11 == 0).select(
        doc.alias("document_id"), F.lit(2).cast("long").alias("seq"), F.lit("Rejected").alias("status"),
        F.create_map().cast("map<string,string>").alias("fields"),
    )
    return corrections.unionByName(rejections)


def doc_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of recognised text: one per conversation turn, whose text stands in all three regions."""
    text, size = F.col("text"), F.length("text")
    reason = lambda n: F.when(n % 5 == 0, "length").otherwise("stop")
    return read_table(spark, folder, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        F.col("turn").cast("long").alias("page_no"),
        text.alias("header_text"),
        text.alias("body_text"),
        text.alias("footer_text"),
        size.cast("long").alias("h_tokens"),
        size.cast("long").alias("b_tokens"),
        size.cast("long").alias("f_tokens"),
        reason(size).alias("h_reason"),
        reason(size + 1).alias("b_reason"),
        reason(size + 2).alias("f_reason"),
        (size % 40).cast("long").alias("total_lines"),
    )


def invoice_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of the invoices on pages of 25 characters, so that values and amounts run over page ends."""
    texts = invoices(spark, folder).select("doc_id", F.col("ocr_text").alias("t"))
    cut = texts.select("doc_id", "t", F.explode(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / 25))).alias("page_no"))
    return cut.select(
        "doc_id",
        F.col("page_no").cast("long").alias("page_no"),
        F.lit("").alias("header_text"),
        F.substring(F.col("t"), (F.col("page_no") * 25 + 1).cast("int"), F.lit(25)).alias("body_text"),
        F.lit("").alias("footer_text"),
        F.lit(1).cast("long").alias("total_lines"),
    )


def token_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """A model's answer stream: one JSON line per word of a turn, then the closing record."""
    turns = read_table(spark, folder, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("req_id"), F.split("text", " ").alias("words")
    )
    words = turns.select("req_id", F.posexplode("words").alias("pos", "word")).select(
        "req_id",
        F.col("pos").cast("long").alias("seq"),
        F.to_json(
            F.struct(
                F.struct(F.concat("word", F.lit(" ")).alias("content")).alias("message"), F.lit(False).alias("done")
            )
        ).alias("line"),
    )
    # Every third request reports no token count, every fifth ends in a broken line.
    count = F.when(F.col("req_id") % 3 == 0, 0).otherwise(F.size("words"))
    closing = turns.select(
        "req_id",
        F.size("words").cast("long").alias("seq"),
        F.concat(
            F.lit('{"message":{"content":""},"done":true,"done_reason":"'),
            F.when(F.col("req_id") % 5 == 0, "length").otherwise("stop"),
            F.lit('","eval_count":'),
            count.cast("string"),
            F.lit("}"),
        ).alias("line"),
    )
    broken = turns.filter(F.col("req_id") % 5 == 0).select(
        "req_id", (F.size("words") + 1).cast("long").alias("seq"), F.lit('{"message":').alias("line")
    )
    return words.unionByName(closing).unionByName(broken)


def series(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "events").select("user_id", "ts", "event_id", "value")


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Files picked for upload; every third invoice is picked twice."""
    inv = invoices(spark, folder).select(
        F.col("doc_id").alias("pos"),
        F.col("original_filename").alias("name"),
        F.col("n_lines").alias("size"),
        F.col("doc_id").alias("last_modified"),
    )
    again = inv.filter(F.col("pos") % 3 == 0).withColumn("pos", F.col("pos") + F.lit(10**12))
    return inv.unionByName(again)


def field_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of the staged design: one row per invoice, with the values of its fields."""
    from docproof.operators.validation import with_answer, with_field_values

    return with_field_values(with_answer(invoices(spark, folder)))


def result_entries() -> Column:
    """The results of the staged design for each field of a row of ``field_answers``, with evidence and a score."""
    from docproof import constants as C
    from docproof.operators.validation import value_text

    source = {"vendor_name": "vendor_name_en", "customer_name": "customer_name_en"}
    return F.array(
        *(
            F.struct(
                F.lit(field).alias("field"),
                F.nullif(value_text(src, F.col(f"v_{src}")), F.lit("")).alias("value"),
                F.concat(F.lit(f"{field}: "), F.coalesce(value_text(src, F.col(f"v_{src}")), F.lit(""))).alias(
                    "evidence"
                ),
                ((F.col("doc_id") + i) % 101).cast("int").alias("score"),
            )
            for i, field in enumerate(C.STAGED_FIELDS)
            for src in [source.get(field, field)]
        )
    )


def field_results(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of the staged design: one row per invoice and field, with evidence and a score."""
    return field_answers(spark, folder).select("doc_id", "ocr_text", F.inline(result_entries()))
