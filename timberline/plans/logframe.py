"""A fluent wrapper around the operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions import text
from timberline.functions.parse import parse_lines
from timberline.operators import aggregate, detect, events, filters, positions
from timberline.sources import lines, sinks, spots
from timberline.streaming import follow


class LogFrame:
    """A DataFrame of log lines; each method gives a new LogFrame, ``df`` the DataFrame."""

    def __init__(self, df: DataFrame, keys: Sequence[str] = ("line_no",), by: Sequence[str] = ("source",)):
        self.df, self.keys, self.by = df, tuple(keys), tuple(by)

    @classmethod
    def read(cls, spark: SparkSession, paths: str | Sequence[str]) -> LogFrame:
        return cls(lines.read_lines(spark, paths))

    @classmethod
    def _at(cls, lines_: DataFrame) -> LogFrame:
        """Lines that have offsets and no numbers: offsets order them."""
        return cls(lines_.withColumn("line_no", F.col("byte_offset")))

    @classmethod
    def last(cls, spark: SparkSession, path: str, n: int) -> LogFrame:
        """The last n raw lines of a file, of which only the end is read."""
        return cls._at(spots.tail(spark, path, n))

    @classmethod
    def rewind(cls, spark: SparkSession, path: str, end: int, n: int) -> LogFrame:
        """The last n raw lines before a byte offset, of which only the surroundings are read."""
        return cls._at(spots.rewind(spark, path, end, n))

    @classmethod
    def seek(cls, spark: SparkSession, path: str, target: datetime) -> LogFrame:
        """The raw lines of a file in order of time from the first at or after the target on."""
        found = spots.seek(spark, path, target)
        return cls._at(spots.lines_of(spark, path, os.path.getsize(path.removeprefix("file://")) if found is None else found))

    @classmethod
    def follow(cls, spark: SparkSession, path: str, start: str = "end") -> LogFrame:
        """The parsed lines that are appended to a file, as a stream."""
        return cls(follow.follow(spark, path, start))

    def _of(self, df: DataFrame) -> LogFrame:
        return LogFrame(df, self.keys, self.by)

    def pipe(self, operator: Callable[..., DataFrame], *args, **options) -> LogFrame:
        """Any operator of this package."""
        return self._of(operator(self.df, *args, **options))

    def parse(self, keep_bad: bool = False) -> LogFrame:
        return self._of(parse_lines(self.df, keep_bad=keep_bad))

    def between(self, since=None, until=None) -> LogFrame:
        return self._of(filters.time_range(self.df, since, until))

    def min_severity(self, least) -> LogFrame:
        return self._of(filters.min_severity(self.df, least))

    def grep(self, pattern: str, invert: bool = False) -> LogFrame:
        return self._of(filters.grep(self.df, pattern, invert))

    def dedupe(self) -> LogFrame:
        return self._of(events.dedupe_runs(self.df, self.keys, self.by))

    def sample(self, n: int) -> LogFrame:
        return self._of(events.sample_every(self.df, n, self.keys, self.by))

    def tail(self, n: int) -> LogFrame:
        return self._of(positions.tail(self.df, n, [*self.by, *self.keys]))

    def mask(self, patterns: Sequence[str], column: str = "message") -> LogFrame:
        return self._of(self.df.withColumn(column, text.mask(F.col(column), patterns)))

    def alerts(self, rules: Sequence[detect.Rule]) -> DataFrame:
        return detect.alerts(self.df, rules, ("ts", *self.keys), self.by)

    def counts(self) -> DataFrame:
        return aggregate.level_counts(self.df)

    def write(self, path: str, kind: str = "raw") -> None:
        sinks.write_text(self.df, path, kind, [*self.by, *self.keys])
