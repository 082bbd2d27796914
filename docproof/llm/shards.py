"""Sharding by weighted rendezvous hashing of stable record keys.

Every record scores every shard by a hash of (key, shard) and goes to the best one, so a further shard takes records
only into itself and a share of them that follows the weights. Slots number the records of a shard without gaps in the
order of their keys: records are ranged by key, numbered within (range, shard) and shifted by the counts before them.

Edge cases: a null key is hashed as the empty text; a null text has no bytes (size 1, crc32 0); repeated rows get the
same shard and slots of their own; long texts are only measured and hashed; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docproof.llm.common import staged

DIGITS = 13  # of the md5 in hex: 52 bits are exact in a double


def shard_score(key: Column, shard: int, weight: float) -> Column:
    """The smaller, the better: an exponential waiting time whose rate is the weight."""
    digest = F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary"))
    unit = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)
    return -F.ln(unit) / F.lit(float(weight))


def assign(records: DataFrame, weights: Sequence[float], grown_weight: float = 1.0, key: str = "doc_id",
           text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, grown_shard) for every record, row by row without a shuffle.

    Shards are numbered by their place in ``weights`` (all positive); ``grown_shard`` is the shard once one more of
    ``grown_weight`` has been added. Equal scores go to the smaller number.
    """
    if not weights or min(*weights, grown_weight) <= 0:
        raise ValueError("shards need positive weights")
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    scores = F.array(*[shard_score(name, i, w) for i, w in enumerate([*weights, grown_weight])])
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    measured = records.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
        scores.alias("scores"),
    )
    n = len(weights)
    old = F.slice("scores", 1, n)
    best = F.array_position(old, F.array_min(old)).cast("int") - 1
    taken = F.element_at("scores", n + 1) < F.array_min(old)
    return measured.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), best.alias("shard"),
        F.when(taken, F.lit(n)).otherwise(best).alias("grown_shard"),
    )


def _number(batches):
    """Running number within the task for each shard."""
    seen: dict[int, int] = {}
    for batch in batches:
        shards = batch.column("shard").to_numpy(zero_copy_only=False)
        local = np.zeros(len(shards), np.int64)
        for s in np.unique(shards):
            at = np.flatnonzero(shards == s)
            first = seen.get(int(s), 0)
            local[at] = np.arange(first, first + len(at))
            seen[int(s)] = first + len(at)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local)], names=[*batch.schema.names, "local"])


def with_slots(assigned: DataFrame) -> DataFrame:
    """Add ``slot``: 0, 1, ... within each shard in the order of doc_id."""
    spark = assigned.sparkSession
    kept = staged(assigned)
    # The place of a row in the written table breaks ties, so that a much repeated key still spreads over ranges.
    placed = kept.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    order = ["doc_id", "file", "row"]
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = placed.repartitionByRange(spread, *order).sortWithinPartitions(*order)
    ranged = ranged.select(*assigned.columns, F.spark_partition_id().alias("part"))
    schema = ", ".join(f"{c} {t}" for c, t in [*ranged.dtypes, ("local", "bigint")])
    numbered = staged(ranged.mapInArrow(_number, schema))
    counts = numbered.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    joined = numbered.join(shift, ["shard", "part"])
    return joined.select(*assigned.columns, (F.col("shift") + F.col("local")).alias("slot"))


def shard_records(records: DataFrame, weights: Sequence[float], grown_weight: float = 1.0, key: str = "doc_id",
                  text: str = "text") -> DataFrame:
    return with_slots(assign(records, weights, grown_weight, key, text))
