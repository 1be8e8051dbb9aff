"""Several streams to one, and one to several sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.operators.ordered import Stream


def tagged(sources: Sequence[DataFrame | None]) -> DataFrame:
    """All rows with ``source_idx`` (the place of the source in the list), in no order. Missing sources are ignored; at least one is needed."""
    some = [(i, s) for i, s in enumerate(sources) if s is not None]
    if not some:
        raise ValueError("no sources")
    return reduce(DataFrame.unionByName, [s.withColumn("source_idx", F.lit(i)) for i, s in some])


def merge_sorted(sources: Sequence[DataFrame | None], ts: str = "ts", tie: Sequence[str] = ("line_no",)) -> DataFrame:
    """The tagged rows, globally sorted by time, source, tie columns. The sort is by range over all partitions."""
    return tagged(sources).orderBy(ts, "source_idx", *tie)


def merge_rank(df: DataFrame, keys: Sequence[str], out: str = "merge_rank") -> DataFrame:
    """df with each row's place (from 1) in the order of the keys; df needn't be sorted."""
    return Stream(df, keys).position(out).df


def until_bad_line(df: DataFrame, good: str = "ts", order: str = "line_no", by: str = "source_idx") -> DataFrame:
    """Each source up to, and without, its first row whose ``good`` is null."""
    first = df.groupBy(by).agg(F.min(F.when(F.col(good).isNull(), F.col(order))).alias("_bad"))
    return df.join(first, by).filter(F.col("_bad").isNull() | (F.col(order) < F.col("_bad"))).drop("_bad")


def good_lines(df: DataFrame, on_bad_line: str = "stop", by: str = "source_idx", order: str = "line_no") -> DataFrame:
    """Several files' parsed lines without the bad ones (null ts). stop: a bad line ends its file; skip: it goes."""
    if on_bad_line not in ("stop", "skip"):
        raise ValueError(f"on_bad_line is stop or skip, not {on_bad_line!r}")
    rows = until_bad_line(df, order=order, by=by) if on_bad_line == "stop" else df
    return rows.filter("ts is not null")


def multifile(df: DataFrame, on_bad_line: str = "stop", by: str = "source_idx", order: str = "line_no") -> DataFrame:
    """The good lines of several files in their merged order."""
    return good_lines(df, on_bad_line, by, order).orderBy("ts", by, order)


class Fanout:
    """Writes a DataFrame to several sinks in the order they were added; one's failure doesn't stop the others."""

    def __init__(self, *sinks: Callable[[DataFrame], None] | None):
        self._sinks = [s for s in sinks if s is not None]

    def add(self, sink: Callable[[DataFrame], None] | None) -> None:
        if sink is not None:
            self._sinks.append(sink)

    def __len__(self) -> int:
        return len(self._sinks)

    def send(self, df: DataFrame) -> list[Exception]:
        """The failures, in order."""
        failed: list[Exception] = []
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for sink in self._sinks:
                try:
                    sink(df)
                except Exception as e:
                    failed.append(e)
        finally:
            df.unpersist()
        return failed

    def batch(self) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: raises after all sinks were tried."""

        def run(df: DataFrame, _: int) -> None:
            if failed := self.send(df):
                raise ExceptionGroup("sinks failed", failed)

        return run
