"""Tables as DataFrames: readers, defaults for columns added later, and the first demo record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docproof import constants as C
from docproof.functions.text import file_stem, file_suffix, safe_basename

# Columns that older document tables lack, with the value they are filled with.
ADDED_COLUMNS = {
    "ocr_text": "",
    "raw_llm_response": "",
    "extracted_json": "{}",
    "validation_result": "{}",
    "excel_file_path": "",
    "extraction_engine": "qwen2.5-vl",
    "processing_timings": "{}",
}

DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("session_id", T.LongType()),
        T.StructField("filename", T.StringType()),
        T.StructField("original_filename", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("document_type", T.StringType()),
        T.StructField("json_output", T.StringType()),
        T.StructField("ocr_text", T.StringType()),
        T.StructField("raw_llm_response", T.StringType()),
        T.StructField("extracted_json", T.StringType()),
        T.StructField("validation_result", T.StringType()),
        T.StructField("excel_file_path", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("processing_time", T.DoubleType()),
        T.StructField("page_count", T.IntegerType()),
        T.StructField("extraction_engine", T.StringType()),
        T.StructField("processing_timings", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)

HISTORY_COLUMNS = ("id", "filename", "document_type", "status", "confidence", "created_at")



def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_documents(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Document tables written at different times, read as one schema with defaults filled in."""
    reader = spark.read.option("mergeSchema", True) if file_format == "parquet" else spark.read
    return schema_backfill(reader.format(file_format).load(path))


def schema_backfill(documents: DataFrame) -> DataFrame:
    """Add the columns an older table lacks and fill blank extracted JSON from the stored output."""
    defaults = {
        name: F.coalesce(F.col(name), F.lit(value)) if name in documents.columns else F.lit(value)
        for name, value in ADDED_COLUMNS.items()
    }
    filled = documents.withColumns(defaults)
    blank = F.col("extracted_json").isin("{}", "")
    return filled.withColumn("extracted_json", F.when(blank, F.col("json_output")).otherwise(F.col("extracted_json")))


def document_history(documents: DataFrame) -> DataFrame:
    """Every document, newest first, six columns."""
    return documents.select(*HISTORY_COLUMNS).orderBy(F.desc("created_at"), F.desc("id"))


def document_by_id(documents: DataFrame, document_id: int) -> DataFrame:
    return documents.filter(F.col("id") == document_id)


def ingest_manifest(files: DataFrame, name: Column, suffixes: tuple[str, ...]) -> DataFrame:
    """File listing with base name, suffix and whether the type is accepted; nothing is dropped."""
    return files.withColumn("filename", safe_basename(name)).withColumn(
        "suffix", F.lower(file_suffix(F.col("filename")))
    ).withColumn("accepted", F.col("suffix").isin(*suffixes))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Listing of a folder of uploads. The content column is never read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "length", "modificationTime")
    )


def storage_name(filename: Column, file_id: Column) -> Column:
    """Unique stored name. Derived from the file's identity, so a retried task writes the same name."""
    mark = F.substr(F.sha2(F.concat_ws("#", filename, file_id.cast("string")), 256), F.lit(1), F.lit(12))
    return F.concat(file_stem(filename), F.lit("_"), mark, file_suffix(filename))


def demo_if_empty(documents: DataFrame) -> dict[str, DataFrame]:
    """Demo rows of the four tables, present only when there is no document yet.

    The count is one row, whatever the size of the table.
    """
    empty = documents.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    at = F.current_timestamp().cast("timestamp_ntz").alias("created_at")
    one = F.lit(1).cast("long")
    return {
        "documents": empty.select(
            one.alias("id"),
            F.lit("sample-invoice.pdf").alias("filename"),
            F.lit("sample-invoice.pdf").alias("original_filename"),
            F.lit("uploads/sample-invoice.pdf").alias("file_path"),
            F.lit("invoice").alias("document_type"),
            F.lit(C.DEMO_JSON).alias("json_output"),
            F.lit("{}").alias("extracted_json"),
            F.lit(0.93).alias("confidence"),
            F.lit("pending_review").alias("status"),
            at,
        ),
        "extractions": empty.select(
            one.alias("document_id"),
            F.lit("Invoice INV-1001 from Northwind Traders").alias("raw_text"),
            F.lit(C.DEMO_JSON).alias("json_output"),
            F.lit(0.93).alias("confidence"),
            F.lit("demo").alias("engine"),
            at,
        ),
        "reviews": empty.select(
            one.alias("document_id"),
            F.lit("system").alias("reviewer_name"),
            F.lit("approved").alias("action"),
            F.lit("Seed record").alias("notes"),
            at,
        ),
        "audit_logs": empty.select(
            one.alias("document_id"),
            F.lit("system").alias("actor"),
            F.lit("seeded").alias("event_type"),
            F.lit('{"message": "Seed document created"}').alias("payload"),
            at,
        ),
    }


def seed_if_empty(documents: DataFrame) -> DataFrame:
    """The documents, or the demo document when there are none."""
    return documents.unionByName(demo_if_empty(documents)["documents"], allowMissingColumns=True)
