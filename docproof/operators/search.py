"""Document search: predicates, order and paging. Everything here is pushed to the scan or a top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docproof.functions.dates import day_end, day_start, iso_timestamp

SEARCH_COLUMNS = ("filename", "original_filename", "extracted_json", "json_output")
DEFAULT_SORT = "created_at"


def matches_text(search: str) -> Column:
    """Substring of any searched column, ignoring case; ``%`` and ``_`` act as wildcards."""
    # A backslash would be LIKE's escape sign; it is data here.
    pattern = "%" + search.strip().replace("\\", "\\\\") + "%"
    found = F.lit(False)
    for name in SEARCH_COLUMNS:
        found = found | F.coalesce(F.col(name).ilike(pattern), F.lit(False))
    return found


GRAM = 3


def _grams(text: Column) -> Column:
    """The distinct runs of ``GRAM`` characters of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def text_postings(documents: DataFrame) -> DataFrame:
    """(gram, id) of everything ``matches_text`` looks at, each once, ready to be written beside the documents.

    Sorted by gram within ranges of (gram, id): a reader's filter on a few grams skips most of it, and a gram that every
    document holds spreads over many files.
    """
    held = F.array_distinct(F.flatten(F.array(*(F.coalesce(_grams(F.col(c)), F.array().cast("array<string>")) for c in SEARCH_COLUMNS))))
    pairs = documents.select(F.explode(held).alias("gram"), "id")
    return pairs.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id")


def search_indexed(documents: DataFrame, postings: DataFrame, search: str) -> DataFrame:
    """The documents ``matches_text`` finds, whose texts are read only where every gram of the text occurs.

    A text of fewer than ``GRAM`` characters, or with the wildcards ``%`` and ``_``, has no gram to look up: all are read.
    """
    wanted = search.strip()
    if len(wanted) < GRAM or "%" in wanted or "_" in wanted:
        return documents.filter(matches_text(search))
    grams = documents.sparkSession.range(1).select(_grams(F.lit(wanted)).alias("g")).first()["g"]
    holders = postings.filter(F.col("gram").isin(*grams)).groupBy("id").agg(F.count_distinct("gram").alias("n"))
    holders = holders.filter(F.col("n") == len(grams)).select("id")
    return documents.join(holders, "id", "left_semi").filter(matches_text(search))


def filter_date_range(df: DataFrame, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Days are inclusive on both sides."""
    if date_from:
        df = df.filter(F.col("created_at") >= day_start(F.lit(date_from)))
    if date_to:
        df = df.filter(F.col("created_at") < day_end(F.lit(date_to)))
    return df


def search_documents(
    documents: DataFrame,
    search: str | None = None,
    document_type: str | None = None,
    status: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    """All documents that meet the given conditions; a condition left empty does not apply."""
    found = documents
    if search:
        found = found.filter(matches_text(search))
    if document_type:
        found = found.filter(F.col("document_type") == document_type)
    if status:
        found = found.filter(F.col("status") == status)
    return filter_date_range(found, date_from, date_to)


def sort_key(documents: DataFrame, sort: str) -> str:
    return sort if sort in documents.columns else DEFAULT_SORT


def sort_by_any(documents: DataFrame, sort: str = DEFAULT_SORT, descending: bool = True) -> DataFrame:
    """Order by any column, by creation time for unknown names; the id breaks ties."""
    direction = F.desc if descending else F.asc
    return documents.orderBy(direction(sort_key(documents, sort)), direction("id"))


def page_documents(
    documents: DataFrame, page: int = 1, page_size: int = 12, sort: str = DEFAULT_SORT, descending: bool = True
) -> DataFrame:
    """One page of the sorted documents. For pages far down use ``page_ranked`` or ``page_after``, whose cost does not grow."""
    return sort_by_any(documents, sort, descending).offset((page - 1) * page_size).limit(page_size)


def page_after(
    documents: DataFrame, last_value: Column, last_id: int, page_size: int = 12, sort: str = DEFAULT_SORT,
    descending: bool = True,
) -> DataFrame:
    """The page that follows a given row, whatever its depth: a pushed-down filter and a top-k."""
    key, doc = F.col(sort_key(documents, sort)), F.col("id")
    beyond = (key < last_value) if descending else (key > last_value)
    tie = (key == last_value) & ((doc < last_id) if descending else (doc > last_id))
    return sort_by_any(documents.filter(beyond | tie), sort, descending).limit(page_size)


def write_ranked(
    documents: DataFrame, path: str, sort: str = DEFAULT_SORT, descending: bool = True, ranges: int = 200
) -> None:
    """Store the documents in order, cut into ``ranges`` of about equal size, with a directory of their ranks.

    The id is part of the cuts, so a value that many documents share spreads over ranges. The directory has a row for
    each range: its number, its documents and how many come before it.
    """
    direction = F.desc if descending else F.asc
    order = [direction(sort_key(documents, sort)), direction("id")]
    cut = documents.repartitionByRange(ranges, *order).withColumn("rank_range", F.spark_partition_id())
    cut.sortWithinPartitions("rank_range", *order).write.partitionBy("rank_range").parquet(f"{path}/rows")
    # Without a row nothing is written by partition, so names and types are kept by an empty table.
    cut.limit(0).write.parquet(f"{path}/columns")
    stored = documents.sparkSession.read.schema(cut.schema).parquet(f"{path}/rows")
    counts = stored.groupBy("rank_range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("rank_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts.withColumn("before", before).write.parquet(f"{path}/ranges")  # one row a range, so one task is enough


def page_ranked(
    spark: SparkSession, path: str, page: int = 1, page_size: int = 12, sort: str = DEFAULT_SORT, descending: bool = True
) -> DataFrame:
    """Any page of what ``write_ranked`` stored in the same order: only the ranges it lies in are read."""
    first = (page - 1) * page_size
    on_page = (F.col("before") < first + page_size) & (F.col("before") + F.col("n") > first)
    found = spark.read.parquet(f"{path}/ranges").filter(on_page).select("rank_range", "before").collect()
    rows = spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows")
    rows = rows.filter(F.col("rank_range").isin([r["rank_range"] for r in found])).drop("rank_range")
    skipped = min((r["before"] for r in found), default=first)
    return sort_by_any(rows, sort, descending).offset(first - skipped).limit(page_size)


def search_total(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("total"))


def newest(documents: DataFrame, n: int) -> DataFrame:
    return sort_by_any(documents).limit(n)


def select_ids(documents: DataFrame, ids: DataFrame, limit: int | None = None) -> DataFrame:
    """Documents whose id is listed; with a ``limit``, taken from the newest ones only."""
    pool = documents if limit is None else newest(documents, limit)
    return pool.join(ids.select("id"), "id", "left_semi")


def document_list(documents: DataFrame) -> DataFrame:
    """The six columns of the list view."""
    return documents.select(
        "id", "filename", "document_type", "status", "confidence", iso_timestamp(F.col("created_at")).alias("created_at")
    )
