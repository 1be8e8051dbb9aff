"""Places in a log file found by reading a few chunks of it: its last lines, the lines before a place, a time.

The file's lines are in order of time for seek(). The lines themselves come from data source ``logfile``, from that place on.
"""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.parse import parse_lines
from timberline.sources.logfile import register

CHUNK = 65536
# Places that are looked at in one round of a search.
PROBES = 16


class FileBytes:
    """Random access to a file; ``taken`` counts the bytes that were read."""

    def __init__(self, path: str):
        self.path, self.size, self.taken = path.removeprefix("file://"), os.path.getsize(path.removeprefix("file://")), 0

    def read(self, at: int, n: int) -> bytes:
        with open(self.path, "rb") as f:
            f.seek(at)
            data = f.read(n)
        self.taken += len(data)
        return data


def lines_of(spark: SparkSession, path: str, begin: int, end: int | None = None) -> DataFrame:
    """source, byte_offset, raw of the lines that begin in [begin, end); begin is a line's begin."""
    register(spark)
    reader = spark.read.format("logfile").option("path", path.removeprefix("file://")).option("offset", begin)
    return (reader if end is None else reader.option("end", end)).load()


def lines_before(file: FileBytes, end: int, n: int, chunk: int = CHUNK) -> int:
    """Where the last n of the lines that begin before ``end`` begin; 0 if there are no more."""
    end = min(end, file.size)
    if n <= 0 or end <= 0:
        return end
    at = end - 1  # a newline right before end closes the last line
    while at > 0:
        begin = max(0, at - chunk)
        data = file.read(begin, at - begin)
        place = len(data)
        while (place := data.rfind(b"\n", 0, place)) >= 0:
            n -= 1
            if n == 0:
                return begin + place + 1
        at = begin
    return 0


def tail(spark: SparkSession, path: str, n: int, chunk: int = CHUNK) -> DataFrame:
    """The last n raw lines of the file."""
    if n <= 0:
        raise ValueError("tail needs n > 0")
    file = FileBytes(path)
    return lines_of(spark, path, lines_before(file, file.size, n, chunk), file.size)


def rewind(spark: SparkSession, path: str, end: int, n: int, chunk: int = CHUNK) -> DataFrame:
    """The last n of the raw lines that begin before byte ``end``; none if n <= 0."""
    file = FileBytes(path)
    end = min(max(end, 0), file.size)
    return lines_of(spark, path, lines_before(file, end, n, chunk) if n > 0 else end, end)


def _whole_lines(file: FileBytes, at: int, n: int) -> list[tuple[int, str]]:
    """(offset, text) of the whole lines that begin in [at, at + n) and are there, read with n bytes."""
    data = file.read(max(0, at - 1), n + 1)
    begin = 0 if at == 0 else data.find(b"\n") + 1
    if at and not begin:
        return []
    out = []
    while (stop := data.find(b"\n", begin)) >= 0:
        out.append((max(0, at - 1) + begin, data[begin:stop].decode("utf-8", "replace")))
        begin = stop + 1
    return out


def seek(spark: SparkSession, path: str, target: datetime, chunk: int = CHUNK, file: FileBytes | None = None) -> int | None:
    """The offset of the first line at or after the target in a file in order of time; None stands for its end.

    Each round looks at PROBES places between the bounds and parses what it finds there; lines that don't parse are passed
    over. About PROBES * chunk bytes a round, and rounds grow with the logarithm of the size.
    """
    file = file or FileBytes(path)
    low, high, size = 0, file.size, chunk
    while high - low > PROBES * size:
        rows = [(i, *line) for i in range(PROBES) for line in _whole_lines(file, low + (high - low) * (i + 1) // (PROBES + 1), size)]
        found = parse_lines(spark.createDataFrame(rows, "probe int, offset long, raw string")) if rows else None
        first = found.groupBy("probe").agg(F.min_by(F.struct("offset", (F.col("ts") < F.lit(target)).alias("before")), "offset").alias("x")).collect() if rows else []
        below, above = [r["x"]["offset"] for r in first if r["x"]["before"]], [r["x"]["offset"] for r in first if not r["x"]["before"]]
        now = max([low, *below]), min([high, *above])
        if now == (low, high):
            size *= 4  # no line here: long lines, or many that don't parse
        low, high = now
    rest = parse_lines(lines_of(spark, path, low, high)).filter(F.col("ts") >= F.lit(target)).agg(F.min("byte_offset")).first()[0]
    return rest if rest is not None else high if high < file.size else None
