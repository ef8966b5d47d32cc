"""Calendar partitions in zones whose clocks change, and the check of a partition's ends."""

from datetime import datetime as d

import pytest
from pyspark.sql import functions as F

from sparkgauge.operators import portfolio


def cells(df):
    return [(r.bucket, r.since, r.until, r.partial_start, r.partial_end) for r in df.orderBy("since").collect()]


def test_months_of_a_zone(spark):
    got = cells(portfolio.calendar_partition(spark, "2024-02-15 00:00:00", "2024-05-01 04:00:00", "month", "America/New_York"))
    assert got == [
        ("2024-02", d(2024, 2, 15), d(2024, 3, 1, 5), True, False), ("2024-03", d(2024, 3, 1, 5), d(2024, 4, 1, 4), False, False), ("2024-04", d(2024, 4, 1, 4), d(2024, 5, 1, 4), False, False),
    ]


def test_weeks_begin_on_monday(spark):
    got = cells(portfolio.calendar_partition(spark, "2024-01-03 00:00:00", "2024-01-15 00:00:00", "week", "UTC"))
    assert got == [("week-2024-01-01", d(2024, 1, 3), d(2024, 1, 8), True, False), ("week-2024-01-08", d(2024, 1, 8), d(2024, 1, 15), False, False)]


def test_skipped_and_repeated_boundaries(spark):
    with pytest.raises(Exception, match="no such local time"):  # clocks went from 24:00 to 01:00 as August began
        portfolio.calendar_partition(spark, "2014-07-10 00:00:00", "2014-08-10 00:00:00", "month", "Africa/Cairo").collect()
    at = spark.range(1).select(portfolio.to_instant(F.lit("2024-11-03 00:30:00").cast("timestamp_ntz"), "America/Havana").alias("x"))
    assert at.first().x == d(2024, 11, 3, 5, 30)  # shown twice: the later one, in standard time


def test_ends_of_a_partition(spark):
    rows = [("a", d(2024, 1, 1), d(2024, 1, 5)), ("b", d(2024, 1, 6), d(2024, 1, 8)), ("c", d(2024, 1, 7), d(2024, 1, 9))]
    buckets = spark.createDataFrame(rows, "bucket string, since timestamp_ntz, until timestamp_ntz")
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    faults = portfolio.partition_faults(buckets, at("2024-01-01 00:00:00"), at("2024-01-10 00:00:00"))
    assert sorted((r.bucket, r.problem) for r in faults.collect()) == [("b", "gap"), ("c", "end"), ("c", "gap")]
    assert portfolio.partition_faults(buckets.where("bucket = 'a'"), at("2024-01-01 00:00:00"), at("2024-01-05 00:00:00")).count() == 0
