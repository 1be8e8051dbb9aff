"""Counts: time buckets, severities, run statistics, named buckets."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from timberline.schema import SEVERITIES

# Seconds from 0001-01-01 to 1970-01-01: buckets are counted from the former.
_YEAR_ONE = 62_135_596_800


def bucket_start(ts: Column, width: timedelta) -> Column:
    """The start of the bucket that ts lies in; a width <= 0 is a minute."""
    us = (width if width > timedelta(0) else timedelta(minutes=1)) // timedelta(microseconds=1)
    at = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(at - F.pmod(at + F.lit(_YEAR_ONE * 1_000_000), F.lit(us)))


def bucket_counts(df: DataFrame, width: timedelta, ts: str = "ts") -> DataFrame:
    """start, one column a severity (lower case), total; rows without ts don't count; sorted by start at the sink only."""
    rows = df.filter(F.col(ts).isNotNull())
    counts = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES]
    return rows.groupBy(bucket_start(F.col(ts), width).alias("start")).agg(*counts, F.count(F.lit(1)).alias("total"))


def bucket_cardinality(df: DataFrame, width: timedelta, ts: str = "ts") -> DataFrame:
    """buckets: how many have a row."""
    starts = df.filter(F.col(ts).isNotNull()).select(bucket_start(F.col(ts), width).alias("start")).distinct()
    return starts.agg(F.count(F.lit(1)).alias("buckets"))


def level_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def level_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def run_stats(df: DataFrame, matches: Column, raw: str = "raw") -> DataFrame:
    """lines_read, lines_matched, bytes_read of parsed lines."""
    return df.agg(F.count(F.lit(1)).alias("lines_read"), F.count_if(F.coalesce(matches, F.lit(False))).alias("lines_matched"), F.coalesce(F.sum(F.octet_length(raw)), F.lit(0)).cast("long").alias("bytes_read"))


def observe(df: DataFrame, matches: Column, raw: str = "raw") -> tuple[DataFrame, Observation]:
    """The same statistics gathered while df is used for something else."""
    seen = Observation("run")
    return df.observe(seen, F.count(F.lit(1)).alias("lines_read"), F.count_if(F.coalesce(matches, F.lit(False))).alias("lines_matched"), F.coalesce(F.sum(F.octet_length(raw)), F.lit(0)).alias("bytes_read")), seen


def stats_text(stats: dict, seconds: float) -> str:
    return f"lines read: {stats['lines_read']}, matched: {stats['lines_matched']}, bytes read: {stats['bytes_read']}, elapsed: {seconds:.3f}s"


def split(df: DataFrame, key: Column, out: str = "bucket") -> DataFrame:
    """df with the bucket's name; rows with a null or empty one go."""
    return df.withColumn(out, key.cast("string")).filter(F.coalesce(F.col(out), F.lit("")) != "")


def split_keys(df: DataFrame, key: Column, out: str = "bucket") -> DataFrame:
    return split(df, key, out).select(out).distinct()


def split_bucket(df: DataFrame, key: Column, name: str) -> DataFrame:
    """The rows of one bucket (none if there is no such bucket)."""
    return split(df, key, "_bucket").filter(F.col("_bucket") == name).drop("_bucket")


def count_rows(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
