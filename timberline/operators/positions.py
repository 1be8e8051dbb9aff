"""Reading a part of a file by position or time: tails, rewinding, sparse time indexes, seeking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.operators.ordered import Stream


def last_rows(df: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """The last n rows: a top-n a partition, then of those, never a full sort."""
    return df.orderBy(*[F.desc(k) for k in keys]).limit(n)


def tail(df: DataFrame, n: int, keys: Sequence[str] = ("line_no",), good: str = "ts") -> DataFrame:
    """Of the last n raw lines those that parse (``good`` not null)."""
    if n <= 0:
        raise ValueError("tail needs n > 0")
    return last_rows(df, n, keys).filter(F.col(good).isNotNull())


def tail_matching(df: DataFrame, n: int, keys: Sequence[str] = ("line_no",)) -> DataFrame:
    """The last n of rows that were filtered already; n <= 0: all."""
    return last_rows(df, n, keys) if n > 0 else df


def rewind(df: DataFrame, end: int, n: int, offset: str = "byte_offset", good: str = "ts") -> DataFrame:
    """Of the last n lines that begin before byte ``end`` those that parse; none if n <= 0."""
    return last_rows(df.filter(F.col(offset) < end), max(0, n), [offset]).filter(F.col(good).isNotNull())


def build_index(df: DataFrame, every: int = 500, keys: Sequence[str] = ("line_no",), by: Sequence[str] = (), ts: str = "ts", offset: str = "byte_offset", line: str = "line_no") -> DataFrame:
    """by, line, ts, offset of every N-th line (N <= 0: 500) that has a time later than all entries before; line 0 always."""
    every = every if every > 0 else 500
    picked = df.filter((F.col(line) % every == 0) & F.col(ts).isNotNull()).select(*by, *dict.fromkeys([line, ts, offset, *keys]))
    s = Stream(picked, keys, by).max_before(F.col(ts), "_top")
    return s.df.filter(F.col("_top").isNull() | (F.col(ts) > F.col("_top")) | (F.col(line) == 0)).select(*by, line, ts, offset)


def floor_offset(index: DataFrame, targets: DataFrame, ts: str = "ts", offset: str = "byte_offset", target: str = "target") -> DataFrame:
    """For each target time the offset of the latest entry not after it (of equal times the last entry), else null.

    An as-of lookup by one sort: entries and targets in one stream, each target takes the last entry before it.
    """
    a = index.select(F.col(ts).alias("_at"), F.lit(0).alias("_kind"), F.col(offset).alias("_o"), F.lit(None).cast(dict(targets.dtypes)[target]).alias("_t"))
    b = targets.select(F.col(target).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_o"), F.col(target).alias("_t"))
    s = Stream(a.unionByName(b).filter("_at is not null"), ["_at", "_kind", "_o"]).last_before(F.col("_o"), "_found", ignore_nulls=True)
    return s.df.filter("_kind = 1").select(F.col("_t").alias(target), F.col("_found").alias(offset))


def seek_to_time(df: DataFrame, target, ts: str = "ts", offset: str = "byte_offset") -> DataFrame:
    """offset: of the first line at or after the target; null stands for the end of the file."""
    return df.filter(F.col(ts) >= F.lit(target).cast("timestamp")).agg(F.min(offset).alias(offset))


def from_offset(df: DataFrame, start: int, offset: str = "byte_offset") -> DataFrame:
    """Lines that begin at byte ``start`` or later."""
    return df.filter(F.col(offset) >= start)
