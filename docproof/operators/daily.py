"""Tables kept by day, and summaries of a day that merge into those of any range of days.

Rows lie in folders of a period (a day, or a month or year where days are small). Storing a period again replaces its
folder and no other, so a repeated job changes nothing and a late document costs one period. Readers name days, and only
folders of their periods are listed and read.

Two summaries are kept beside the documents, so that a dashboard over years reads no document: the counts of each tick
of a stage's time, which add up exactly, and a KLL sketch of the confidences, which merges within its rank error. Both
combine before their shuffle, so a day that holds most rows costs one row per task and tick.

Rows without a time lie in a folder of their own that no range of days reads. Days without rows add nothing; a range
without any day gives no latency rows, and a count of 0 with null quantiles.
"""

from __future__ import annotations

import datetime as dtm

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docproof.operators.analytics import latency_of_ticks, stage_ticks

UNITS = ("day", "month", "year")
SKETCH_SIZE = 1024  # KLL parameter k; at 1024 ranks are off by some 0.3 % of the rows, with 99 % certainty
RANK_ERROR = 0.005


def _day(at: str) -> Column:
    return F.col(at).cast("date")


def _first_day(day: str, unit: str) -> dtm.date:
    found = dtm.date.fromisoformat(day)
    return found.replace(day=1 if unit != "day" else found.day, month=1 if unit == "year" else found.month)


def write_days(rows: DataFrame, path: str, unit: str = "day") -> None:
    """Store rows with a ``day`` in the folders of their periods; periods among the rows are replaced, others stay."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    period = F.date_trunc(unit, F.col("day")).cast("date")
    # Rebalancing gives each period few files and still splits a period that holds most rows.
    (
        rows.withColumn("period", period)
        .hint("rebalance", "period")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("period")
        .parquet(path)
    )


def read_days(spark: SparkSession, path: str, first: str, last: str, unit: str = "day") -> DataFrame:
    """Rows of the days from ``first`` to ``last``, both inclusive; other periods' folders are not read."""
    periods = F.col("period").between(F.lit(_first_day(first, unit)), F.lit(_first_day(last, unit)))
    days = F.col("day").between(F.lit(dtm.date.fromisoformat(first)), F.lit(dtm.date.fromisoformat(last)))
    return spark.read.parquet(path).filter(periods & days).drop("period")


def with_day(documents: DataFrame, at: str = "created_at") -> DataFrame:
    """Documents as ``write_days`` takes them."""
    return documents.withColumn("day", _day(at))


def latency_by_day(documents: DataFrame, at: str = "created_at", ticks_per_second: int = 10_000) -> DataFrame:
    """How often each stage took each number of ticks, by day."""
    ticks = stage_ticks(documents, ticks_per_second, _day(at).alias("day"))
    return ticks.groupBy("day", "stage", "tick").agg(F.count(F.lit(1)).alias("n"))


def latency_over(days: DataFrame, p: float = 0.95, ticks_per_second: int = 10_000) -> DataFrame:
    """Stage latency of stored days, equal to one pass over their documents."""
    return latency_of_ticks(days.groupBy("stage", "tick").agg(F.sum("n").alias("n")), p, ticks_per_second)


def confidence_by_day(documents: DataFrame, at: str = "created_at", size: int = SKETCH_SIZE) -> DataFrame:
    """A sketch of the confidences of each day, and how many there are."""
    known = documents.select(_day(at).alias("day"), F.col("confidence").cast("double").alias("confidence"))
    return known.groupBy("day").agg(
        F.kll_sketch_agg_double("confidence", F.lit(size)).alias("sketch"), F.count("confidence").alias("n")
    )


def confidence_over(days: DataFrame, shares: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """One row: confidences counted, and their quantiles within the sketch's rank error."""
    wanted = F.array(*(F.lit(float(s)) for s in shares))
    merged = days.filter(F.col("n") > 0).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    quantiles = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", wanted))
    return merged.select(F.coalesce("n", F.lit(0)).alias("counted"), quantiles.alias("quantiles"))
