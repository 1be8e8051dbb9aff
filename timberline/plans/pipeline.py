"""The composed plans: a plain slice, and the pipeline of all stages in their order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.parse import parse_lines
from timberline.functions.text import truncate
from timberline.operators import events, filters, positions
from timberline.operators.ordered import Ranges
from timberline.plans.config import Config


def slice_lines(df: DataFrame, since=None, until=None, least: str | None = None) -> DataFrame:
    """Parses raw lines and keeps those in range and severe enough; empty and unparseable lines go."""
    return filters.match(parse_lines(df), since, until, least)


def process(df: DataFrame, config: Config, keys: Sequence[str] = ("line_no",), by: Sequence[str] = ("source",)) -> DataFrame:
    """Parsed lines through filter, dedupe, sample, rate limit, truncate, tail, in this order.

    Each order-dependent stage counts what the stage before let pass. raw is cut last.
    """
    config.validate()
    least = config.min_severity or None
    df = filters.grep(filters.min_severity(filters.time_range(df, config.since, config.until), least, strict=config.strict), config.grep, config.invert)
    timed = ["ts", *[k for k in keys if k != "ts"]]
    ranges = Ranges.by_key(df, keys[0]) if config.dedupe or config.sample_rate > 1 else None  # looked up once for all stages
    if config.dedupe_window:
        df = events.dedupe_within(df, config.dedupe_window, timed, by)
    elif config.dedupe:
        df = events.dedupe_runs(df, keys, by, ranges=ranges).drop("repeats")
    df = events.sample_every(df, config.sample_rate, keys, by, ranges)
    df = events.rate_limit(df, config.rate_limit, timed, by)
    if config.max_line_len:
        df = df.withColumn("raw", truncate(F.col("raw"), config.max_line_len, config.suffix))
    return positions.tail_matching(df, config.tail_n, [*by, *keys])
