"""The log line schema and the severity scale."""

from __future__ import annotations

from pyspark.sql import types as T

# Severity names in rank order. Rank 0 is anything else.
SEVERITIES = ("UNKNOWN", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
ALIASES = {"WARNING": "WARN"}
RANK = {name: rank for rank, name in enumerate(SEVERITIES)}

LOG_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("source_idx", T.IntegerType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("byte_offset", T.LongType()),
        T.StructField("raw", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("tz_offset", T.StringType()),
        T.StructField("severity_rank", T.IntegerType()),
        T.StructField("severity", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    ]
)


def severity_rank_of(name: str, strict: bool = True) -> int:
    """The rank of a severity name (upper case only). Unknown names raise; with strict=False they are rank 0."""
    rank = RANK.get(ALIASES.get(name, name), 0)
    if not rank and strict:
        raise ValueError(f"unknown severity: {name!r}")
    return rank
