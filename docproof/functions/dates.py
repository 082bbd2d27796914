"""Dates and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docproof import constants as C


def parse_date(text: Column) -> Column:
    """The first accepted layout that reads the whole text; null when none does."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(spark)) for spark, _ in C.DATE_LAYOUTS))


def is_valid_date(text: Column) -> Column:
    return parse_date(text).isNotNull()


def normalize_date_iso(text: Column) -> Column:
    return F.date_format(parse_date(text), "yyyy-MM-dd")


def day_start(day: Column) -> Column:
    return day.cast("date").cast("timestamp_ntz")


def day_end(day: Column) -> Column:
    """First instant after the day: an exclusive upper bound."""
    return F.date_add(day.cast("date"), 1).cast("timestamp_ntz")


def iso_timestamp(ts: Column) -> Column:
    """ISO text with microseconds, which are left out when zero."""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.regexp_replace(text, r"\.000000$", "")


def display_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "dd MMM yyyy, hh:mm a")


def display_day(ts: Column) -> Column:
    return F.date_format(ts, "dd MMM yyyy")
