"""Row filters that need no order: time range, severity, patterns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.regex import to_java
from timberline.schema import severity_rank_of


def time_range(df: DataFrame, since: datetime | str | None = None, until: datetime | str | None = None, ts: str = "ts") -> DataFrame:
    """since <= ts <= until, each end optional; a null ts passes only when neither end is set."""
    if since is not None:
        df = df.filter(F.col(ts) >= F.lit(since).cast("timestamp"))
    if until is not None:
        df = df.filter(F.col(ts) <= F.lit(until).cast("timestamp"))
    return df


def min_severity(df: DataFrame, least: str | int | None, rank: str = "severity_rank", strict: bool = True) -> DataFrame:
    """Rows ranked at least ``least``; None or rank 0 lets all pass; unknown severities fail any other."""
    k = severity_rank_of(least, strict) if isinstance(least, str) else (least or 0)
    return df.filter(F.col(rank) >= k) if k else df


def grep(df: DataFrame, pattern: str | None, invert: bool = False, ignore_case: bool = False, raw: str = "raw") -> DataFrame:
    """Rows where the pattern is (invert: isn't) found; an empty pattern and null text let rows pass."""
    if not pattern:
        return df
    found = F.col(raw).rlike(("(?i)" if ignore_case else "") + to_java(pattern).text)
    return df.filter(F.coalesce(~found if invert else found, F.lit(True)))


def grep_name(pattern: str | None, invert: bool = False) -> str:
    return "<no pattern>" if not pattern else f"NOT /{pattern}/" if invert else f"/{pattern}/"


def match(df: DataFrame, since=None, until=None, least: str | int | None = None, pattern: str | None = None, invert: bool = False) -> DataFrame:
    """All the above in conjunction: one filter for the optimiser to push down."""
    return grep(min_severity(time_range(df, since, until), least), pattern, invert)
