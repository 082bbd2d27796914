"""Tables and summaries by day against one pass over the documents."""

import datetime as dtm
import random
import re

import pytest
from pyspark.sql import functions as F

from docproof.operators import analytics, daily, search

SCHEMA = "id long, created_at timestamp_ntz, confidence double, processing_timings string"


def at(day, hour=12):
    return dtm.datetime(2026, 1, 1, hour) + dtm.timedelta(days=day)


def made(spark, n=3000, days=40, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        day = 7 if i % 3 == 0 else rnd.randrange(days)  # a third of all rows lies on one day
        stages = ",".join(f'"{s}":{rnd.randrange(90000) / 10000}' for s in ("ocr", "llm")[: 1 + i % 2])
        rows.append((i, at(day, rnd.choice((0, 23))), rnd.randrange(101) / 100, "{%s}" % stages))
    rows += [(n, None, 0.5, '{"ocr":1.0}'), (n + 1, at(3), None, None), (n + 2, at(3), 0.5, "{}"), (n + 3, at(3), 0.5, "no")]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("unit", daily.UNITS)
def test_days_come_back_whole_at_any_unit(spark, tmp_path, unit):
    docs, path = made(spark), str(tmp_path / unit)
    daily.write_days(daily.with_day(docs), path, unit)
    for first, last in (("2026-01-08", "2026-01-08"), ("2026-01-20", "2026-02-03"), ("2025-01-01", "2027-01-01"), ("2027-01-01", "2027-02-01")):
        got = daily.read_days(spark, path, first, last, unit).drop("day")
        assert rows(got.select(*docs.columns)) == rows(search.filter_date_range(docs, first, last))
    assert spark.read.parquet(path).count() == docs.count()  # the row without a time is kept, outside all ranges


def test_only_the_days_asked_for_are_read(spark, tmp_path):
    path = str(tmp_path / "days")
    daily.write_days(daily.with_day(made(spark)), path)
    found = daily.read_days(spark, path, "2026-01-05", "2026-01-07")
    text = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*period#\d+ >= 2026-01-05[^\]]*period#\d+ <= 2026-01-07", text)
    folders = {r["f"] for r in found.select(F.regexp_extract(F.input_file_name(), "period=([^/]*)", 1).alias("f")).collect()}
    assert folders == {"2026-01-05", "2026-01-06", "2026-01-07"}


def test_a_period_stored_again_replaces_itself_only(spark, tmp_path):
    path = str(tmp_path / "days")
    stored = daily.with_day(made(spark)).select("id", "day")
    daily.write_days(stored, path)
    before = rows(spark.read.parquet(path))
    daily.write_days(stored.filter("day = date'2026-01-08'"), path)
    assert rows(spark.read.parquet(path)) == before
    daily.write_days(spark.sql("SELECT 1L AS id, date'2026-01-08' AS day"), path)
    assert daily.read_days(spark, path, "2026-01-08", "2026-01-08").count() == 1
    assert daily.read_days(spark, path, "2026-01-09", "2026-12-31").count() == stored.filter("day > date'2026-01-08'").count()


def test_stored_latency_equals_one_pass(spark, tmp_path):
    docs, path = made(spark), str(tmp_path / "latency")
    daily.write_days(daily.latency_by_day(docs), path, "month")
    for first, last in (("2026-01-02", "2026-01-30"), ("2026-01-08", "2026-01-08"), ("2030-01-01", "2030-01-02")):
        got = daily.latency_over(daily.read_days(spark, path, first, last, "month"))
        assert rows(got) == rows(analytics.stage_latency(search.filter_date_range(docs, first, last)))


def test_merged_sketches_stay_within_their_rank_error(spark, tmp_path):
    path, shares = str(tmp_path / "confidence"), (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)
    # Distinct values, so that ranks are sharp, in an order that differs from day to day.
    docs = spark.range(60_000).select(
        F.expr("timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(CAST(pmod(hash(id), 90) AS INT))").alias("created_at"),
        (F.pmod(F.col("id") * 7919, F.lit(60_000)) / 60_000).alias("confidence"),
    )
    daily.write_days(daily.confidence_by_day(docs), path, "month")
    got = daily.confidence_over(daily.read_days(spark, path, "2026-01-01", "2026-12-31", "month"), shares).first()
    assert got["counted"] == 60_000
    assert all(abs(q - s) <= daily.RANK_ERROR for q, s in zip(got["quantiles"], shares))
    empty = daily.confidence_over(daily.read_days(spark, path, "2030-01-01", "2030-01-02", "month")).first()
    assert empty["counted"] == 0 and empty["quantiles"] is None


def test_null_confidences_are_not_counted(spark):
    docs = made(spark, 50).filter("created_at is not null")
    got = daily.confidence_over(daily.confidence_by_day(docs)).first()
    known = sorted(r["confidence"] for r in docs.collect() if r["confidence"] is not None)
    assert got["counted"] == len(known) and known[0] <= got["quantiles"][2] <= known[-1]
    nulls = docs.withColumn("confidence", F.lit(None).cast("double"))
    assert daily.confidence_over(daily.confidence_by_day(nulls)).first()["quantiles"] is None


def test_unknown_units_are_refused(spark):
    with pytest.raises(ValueError):
        daily.write_days(spark.sql("SELECT date'2026-01-08' AS day"), "/nowhere", "week")
