"""Ordered scans that split long groups.

A window partitioned by a key alone puts the whole key into one task. Here the rows are range-partitioned by key and
order first, each range is scanned on its own, and the few results per range are stitched together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ISLAND_SHARE = 0.05


def with_ranges(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Add ``range_id``: consecutive, size-balanced slices of the rows sorted by key and order."""
    return df.repartitionByRange(key, *order).withColumn("range_id", F.spark_partition_id())


def island_count(series: DataFrame, key: str, value: str, *order: str, share: float = ISLAND_SHARE) -> DataFrame:
    """Runs of values above a share of the key's maximum, counted by their rising edges."""
    peaks = series.groupBy(key).agg(F.max(value).alias("peak"))
    above = series.join(peaks, key).select(
        key, *order, F.coalesce(F.col(value) > F.col("peak") * share, F.lit(False)).alias("above")
    )
    inside = Window.partitionBy("range_id", key).orderBy(*order)
    scanned = with_ranges(above, key, *order).select(
        key, "range_id", "above", F.lag("above").over(inside).alias("prev"), F.lead("above").over(inside).alias("next")
    )
    rising = F.col("above") & ~F.coalesce(F.col("prev"), F.lit(False))
    ranges = scanned.groupBy("range_id", key).agg(
        F.count_if(rising).alias("edges"),
        F.bool_or(F.when(F.col("prev").isNull(), F.col("above"))).alias("starts_above"),
        F.bool_or(F.when(F.col("next").isNull(), F.col("above"))).alias("ends_above"),
    )
    # A run that goes on from the range before was counted in both.
    across = Window.partitionBy(key).orderBy("range_id")
    goes_on = F.col("starts_above") & F.coalesce(F.lag("ends_above").over(across), F.lit(False))
    return (
        ranges.select(key, (F.col("edges") - goes_on.cast("long")).alias("edges"))
        .groupBy(key)
        .agg(F.sum("edges").alias("islands"))
    )
