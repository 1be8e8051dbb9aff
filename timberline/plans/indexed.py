"""Reading a large log file from a time on: a sparse time index, cached, and a jump to its floor."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.parse import parse_lines
from timberline.operators.positions import build_index
from timberline.sources import spots
from timberline.sources.lines import read_lines
from timberline.sources.stores import IndexCache, Warmer


class IndexedLog:
    """A log file with an index of every N-th line's time and offset, built at the first use and while the file is the same."""

    def __init__(self, spark: SparkSession, path: str, every: int = 500, cache: IndexCache | None = None):
        self.spark, self.path, self.every = spark, path, every
        self.warmer = Warmer(cache if cache is not None else IndexCache(ttl_seconds=3600), self._build)

    def _build(self, path: str) -> DataFrame:
        return build_index(parse_lines(read_lines(self.spark, path), keep_bad=True), self.every)

    def index(self) -> DataFrame:
        """line_no, ts, byte_offset, persisted."""
        return self.warmer.warm(self.path)

    def floor(self, target: datetime) -> int:
        """Where to begin to read for lines at or after the target: the last entry before it, else the file's begin."""
        before = F.col("ts") < F.lit(target)
        return self.index().filter(before).agg(F.max("byte_offset")).first()[0] or 0

    def since(self, target: datetime, until: datetime | None = None) -> DataFrame:
        """The parsed lines from the target on (and not after ``until``) of a file in order of time, with their byte offsets.

        Reading begins at the index's floor, and ends at the first entry after ``until``.
        """
        end = self.index().filter(F.col("ts") > F.lit(until)).agg(F.min("byte_offset")).first()[0] if until else None
        rows = parse_lines(spots.lines_of(self.spark, self.path, self.floor(target), end)).filter(F.col("ts") >= F.lit(target))
        return rows.filter(F.col("ts") <= F.lit(until)) if until else rows
