"""Counts and summaries. Every aggregate combines before its shuffle, so a hot key costs one row per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docproof import constants as C
from docproof.functions.jsonio import timings_map


def docs_by_type(documents: DataFrame) -> DataFrame:
    return documents.groupBy(F.col("document_type").alias("label")).agg(F.count("id").alias("value"))


def daily_trend(documents: DataFrame) -> DataFrame:
    day = F.col("created_at").cast("date")
    return documents.groupBy(day.alias("label")).agg(F.count("id").alias("value")).orderBy("label")


def confidence_distribution(documents: DataFrame) -> DataFrame:
    """All confidences in order; a range-partitioned sort, never a list on the driver."""
    # The id only breaks ties: without it all rows of a frequent value would be sorted in one task.
    return documents.select("confidence", "id").orderBy("confidence", "id").select("confidence")


def confidence_summary(documents: DataFrame, bins: int = 20) -> DataFrame:
    """The same distribution in bounded size."""
    return documents.agg(
        F.percentile_approx("confidence", [0.05, 0.25, 0.5, 0.75, 0.95]).alias("quantiles"),
        F.histogram_numeric("confidence", F.lit(bins)).alias("histogram"),
    )


def audit_count(audit_logs: DataFrame) -> DataFrame:
    return audit_logs.agg(F.count("id").alias("value"))


def session_accuracy(sessions: DataFrame, scored: DataFrame) -> DataFrame:
    """Share of field states that need no correction, in percent with one decimal; 100 when there are none.

    ``scored`` holds ``session_id`` and one ``s_<field>`` column per field; the states are counted inside the row.
    """
    states = [F.col(f"s_{f}") for f in C.FIELDS]
    good = sum((s.isin(C.VALID, C.ABSENT).cast("long") for s in states), F.lit(0).cast("long"))
    known = sum((s.isNotNull().cast("long") for s in states), F.lit(0).cast("long"))
    return _accuracy(sessions, scored.groupBy("session_id").agg(F.sum(good).alias("good"), F.sum(known).alias("total")))


def session_accuracy_of_maps(sessions: DataFrame, documents: DataFrame) -> DataFrame:
    """The same from a ``field_states`` map."""
    states = F.map_values("field_states")
    good = F.size(F.filter(states, lambda s: s.isin(C.VALID, C.ABSENT)))
    counts = documents.groupBy("session_id").agg(F.sum(good).alias("good"), F.sum(F.size(states)).alias("total"))
    return _accuracy(sessions, counts)


def one_decimal(x: Column) -> Column:
    """A non-negative double rounded to one decimal as its binary value says; exact ties go to the even digit.

    Twenty times the value is the sum of two exact products, so what its addition rounds off is known exactly, and
    with it the side of a half on which the value lies.
    """
    high, low = x * 16.0, x * 4.0
    twenty = high + low
    lost = low - (twenty - high)
    halves = F.rint(twenty)
    side = (twenty - halves) + lost
    down = F.floor(halves / 2)
    odd = halves % 2 == 1
    up = (side > 0) | ((side == 0) & (down % 2 == 1))
    return F.when(odd & up, down + 1).when(odd, down).otherwise(halves / 2).cast("double") / 10.0


def _accuracy(sessions: DataFrame, counts: DataFrame) -> DataFrame:
    share = one_decimal(F.col("good") / F.col("total") * 100)
    return (
        sessions.select(F.col("id").alias("session_id"))
        .join(counts, "session_id", "left")
        .select("session_id", F.when(F.coalesce("total", F.lit(0)) == 0, 100.0).otherwise(share).alias("accuracy"))
    )


def session_pending(documents: DataFrame) -> DataFrame:
    return (
        documents.groupBy("session_id")
        .agg(F.count_if(F.col("status") == C.NEEDS_REVIEW).alias("pending"))
        .withColumn("review_required", F.col("pending") > 0)
    )


def batch_summary(documents: DataFrame) -> DataFrame:
    """Counts and the rounded mean confidence of each upload batch.

    Confidences have two decimals, so they are summed as integers and do not depend on the order of rows.
    """
    hundredths = F.coalesce(F.round(F.col("confidence") * 100), F.lit(0)).cast("long")
    n, total = F.col("processed"), F.col("total")
    return (
        documents.groupBy("session_id")
        .agg(
            F.count(F.lit(1)).alias("processed"),
            F.count_if(F.col("status") == C.APPROVED).alias("approved"),
            F.count_if(F.col("status") == C.NEEDS_REVIEW).alias("needs_review"),
            F.sum(hundredths).alias("total"),
        )
        .select(
            "session_id",
            "processed",
            "approved",
            "needs_review",
            F.floor((total * 2 + n) / (n * 2)).alias("avg_confidence_pct"),
        )
    )


def session_name(uploads: DataFrame) -> DataFrame:
    """Name of an upload session: its first file, and how many others came with it."""
    first, n = F.col("first_file"), F.col("n")
    return (
        uploads.groupBy("session_id")
        .agg(F.min_by("filename", "pos").alias("first_file"), F.count(F.lit(1)).alias("n"))
        .select(
            "session_id",
            F.when(n == 1, first)
            .otherwise(F.concat(first, F.lit(" and "), (n - 1).cast("string"), F.lit(" other files")))
            .alias("name"),
        )
    )


def stage_ticks(documents: DataFrame, ticks_per_second: int, *keep: Column) -> DataFrame:
    """One row per document and stage: the stage's time in ticks of the resolution it is stored with."""
    entries = documents.select(*keep, F.explode(timings_map(F.col("processing_timings"))).alias("stage", "seconds"))
    kept = entries.columns[:-2]
    return entries.select(*kept, "stage", F.round(F.col("seconds") * ticks_per_second).cast("long").alias("tick"))


def stage_latency(documents: DataFrame, p: float = 0.95, ticks_per_second: int = 10_000) -> DataFrame:
    """Minimum, mean and nearest-rank percentile of each stage's seconds.

    Times are counted per tick of the resolution they are stored with, so the percentile is exact and is read off
    a histogram instead of all values of a stage.
    """
    ticks = stage_ticks(documents, ticks_per_second)
    return latency_of_ticks(ticks.groupBy("stage", "tick").agg(F.count(F.lit(1)).alias("n")), p, ticks_per_second)


def latency_of_ticks(histogram: DataFrame, p: float, ticks_per_second: int) -> DataFrame:
    """The same from how often each stage took each number of ticks."""
    running = Window.partitionBy("stage").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    whole = histogram.groupBy("stage").agg(F.sum("n").alias("total"))
    reached = (
        histogram.withColumn("upto", F.sum("n").over(running))
        .join(whole, "stage")
        .withColumn("is_p", F.col("upto") >= F.col("total") * p)
    )
    seconds = lambda c: c / F.lit(float(ticks_per_second))
    return reached.groupBy("stage").agg(
        F.sum("n").alias("documents"),
        seconds(F.min("tick")).alias("min_seconds"),
        F.round(seconds(F.sum(F.col("tick") * F.col("n"))) / F.sum("n"), 4).alias("avg_seconds"),
        seconds(F.min(F.when(F.col("is_p"), F.col("tick")))).alias("p95_seconds"),
    )
