"""Writing lines: raw text, JSON, one folder a bucket, alerts; time buckets in their order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.text import parse_format, to_json
from timberline.operators.aggregate import split


def as_text(df: DataFrame, kind: str = "raw") -> DataFrame:
    """value: each row's raw line, or its JSON."""
    if parse_format(kind) == "raw":
        return df.select(F.col("raw").alias("value"))
    return df.select(to_json(F.col("ts"), F.col("severity"), F.col("message"), F.col("tz_offset") if "tz_offset" in df.columns else None).alias("value"))


def write_text(df: DataFrame, path: str, kind: str = "raw", keys: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """A folder of text files; with keys the files and their lines are in that order, range by range."""
    as_text(df.orderBy(*keys) if keys else df, kind).write.mode(mode).text(path)


def write_buckets(df: DataFrame, path: str, key: Column, kind: str = "raw") -> None:
    """A folder ``bucket=<name>`` for each bucket."""
    rows = split(df, key)
    value = F.col("raw") if parse_format(kind) == "raw" else to_json(F.col("ts"), F.col("severity"), F.col("message"))
    rows.select("bucket", value.alias("value")).write.partitionBy("bucket").text(path)


def write_alerts(alerts: DataFrame, path: str) -> None:
    alerts.select(F.col("alert").alias("value")).write.text(path)


def write_counts(counts: DataFrame, path: str) -> None:
    """JSON lines of time buckets; files and their lines are in the order of the buckets' starts."""
    counts.orderBy("start").write.json(path)
