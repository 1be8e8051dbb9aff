"""Text files as lines with their line numbers and byte offsets."""

from __future__ import annotations

import atexit
import gzip
import io
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# gzip's first bytes, and the file names that say gzip.
GZIP_MAGIC = b"\x1f\x8b"
GZIP_NAMES = (".gz", ".gzip")
# Lines of a batch that is inflated at a time, and files that are looked at at once.
BATCH_LINES, LOOKERS = 10_000, 32
# Characters of standard input that the driver holds, a line counting as LINE_CHARS more.
STDIN_CHARS, LINE_CHARS = 16 << 20, 100
STDIN_SCHEMA = "source string, source_idx int, line_no long, byte_offset long, raw string"


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_gzip(spark: SparkSession, path: str) -> bool:
    """By its first two bytes, through Spark's file system for that path."""
    p, fs = _file_system(spark, path)
    stream = fs.open(p)
    try:
        return bytes(b & 0xFF for b in (stream.read(), stream.read())) == GZIP_MAGIC
    finally:
        stream.close()


def list_files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The files that paths, patterns and folders (with what is below them) stand for; each once, in the order of the paths, then by name.

    Names that begin with . or _ are left out inside folders. A path without any file raises FileNotFoundError.
    """
    out: dict[str, None] = {}
    for path in paths:
        p, fs = _file_system(spark, path)
        found = fs.globStatus(p)
        if not found:
            raise FileNotFoundError(path)
        todo, files = list(found), []
        while todo:
            f = todo.pop()
            if f.isDirectory():
                todo += [x for x in fs.listStatus(f.getPath()) if not x.getPath().getName().startswith((".", "_"))]
            else:
                files.append(f.getPath().toString())
        if not files:
            raise FileNotFoundError(f"no file in {path}")
        out |= dict.fromkeys(sorted(files))
    return list(out)


def _plain(path: Column) -> Column:
    """A file's path in one spelling: file:/x, file:///x and /x are the same."""
    return F.regexp_replace(path, r"^(?:file:)?/+", "file:/")


def read_lines(spark: SparkSession, paths: str | Sequence[str], max_line_bytes: int | None = None) -> DataFrame:
    """source, source_idx, line_no (from 0), byte_offset, raw (without CR at its end) of every line of the files.

    Paths may be patterns and folders; source_idx is a file's place in list_files(paths). Large files are read in blocks by
    many tasks: a block's lines and bytes are counted first, and the blocks before give a line its number and offset.
    Offsets in compressed files are those of the uncompressed text. A line of max_line_bytes or more raises. Files must
    not change meanwhile.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no paths")
    files = list_files(spark, paths)
    unsaid = [p for p in files if not p.lower().endswith(GZIP_NAMES)]
    with ThreadPoolExecutor(LOOKERS) as pool:
        hidden = {p for p, yes in zip(unsaid, pool.map(lambda p: is_gzip(spark, p), unsaid)) if yes}
    plain = [p for p in files if p not in hidden]
    parts = ([_read_blocks(spark, plain)] if plain else []) + ([_read_hidden_gzip(spark, sorted(hidden))] if hidden else [])
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    numbers = spark.createDataFrame([(p, i) for i, p in enumerate(files)], "_file string, source_idx int")  # a row a file
    numbers = numbers.select(_plain(F.col("_file")).alias("_file"), "source_idx")
    out = out.join(F.broadcast(numbers), _plain(F.col("source")) == F.col("_file"), "left")
    if max_line_bytes:
        fits = F.octet_length("raw") < max_line_bytes
        out = out.withColumn("raw", F.when(fits, F.col("raw")).otherwise(F.raise_error(F.lit("a line is too long")).cast("string")))
    return out.select("source", "source_idx", "line_no", "byte_offset", F.regexp_replace("raw", r"\r\z", "").alias("raw"))


def _literal(path: str) -> str:
    """A file's path as a pattern that matches it alone."""
    return "".join("\\" + c if c in "\\{}[]*?" else c for c in path)


def _read_blocks(spark: SparkSession, paths: list[str]) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text([_literal(p) for p in paths])
    # the metadata's path is percent-encoded
    block = [F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("source"), F.col("_metadata.file_block_start").alias("_block")]
    rows = text.select(*block, F.col("value").alias("raw"), F.monotonically_increasing_id().alias("_id"))
    sums = rows.groupBy("source", "_block").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.octet_length("raw") + 1).alias("_bytes"), F.min("_id").alias("_first"))
    before = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    sums = sums.select("source", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_line"), F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_at"))
    inside = Window.partitionBy("source", "_block").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    both = rows.join(sums, ["source", "_block"])
    offset = F.col("_at") + F.coalesce(F.sum(F.octet_length("raw") + 1).over(inside), F.lit(0))
    return both.select("source", (F.col("_line") + F.col("_id") - F.col("_first")).alias("line_no"), offset.cast("long").alias("byte_offset"), "raw")


def _read_hidden_gzip(spark: SparkSession, paths: list[str]) -> DataFrame:
    """gzip files whose name doesn't say so, one task a file; inflated as it goes, BATCH_LINES lines at a time."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                number, at, lines, starts = 0, 0, [], []
                for line in gzip.GzipFile(fileobj=io.BytesIO(content)):
                    lines.append(line.removesuffix(b"\n").decode("utf-8", "replace"))
                    starts.append(at)
                    at += len(line)
                    if len(lines) == BATCH_LINES:
                        yield pd.DataFrame({"source": path, "line_no": range(number, number + len(lines)), "byte_offset": starts, "raw": lines})
                        number, lines, starts = number + len(lines), [], []
                yield pd.DataFrame({"source": path, "line_no": range(number, number + len(lines)), "byte_offset": pd.Series(starts, dtype="int64"), "raw": pd.Series(lines, dtype=object)})

    files = spark.read.format("binaryFile").load([_literal(p) for p in paths]).select("path", "content")
    return files.mapInPandas(run, "source string, line_no long, byte_offset long, raw string")


def source_sizes(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """source, bytes of each file."""
    return spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths)).select(F.col("path").alias("source"), F.col("length").alias("bytes"))


def _shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors see, gone when the driver ends: below spark.checkpoint.dir, or in local mode a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        path = f"{shared.rstrip('/')}/timberline-stdin-{uuid.uuid4().hex}"
        p, fs = _file_system(spark, path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        return path
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="timberline-stdin-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def from_stdin(spark: SparkSession, stream) -> DataFrame:
    """Lines of an open text stream, read on the driver (a terminal or a pipe).

    The driver holds a batch of STDIN_CHARS or so. A stream of more than one batch goes to the shared folder as Parquet.
    """
    path, at, number = None, 0, 0
    lines, starts, held = [], [], 0

    def batch() -> DataFrame:
        columns = [pa.repeat("-", len(lines)), pa.repeat(pa.scalar(0, pa.int32()), len(lines)), pa.array(range(number - len(lines), number), pa.int64()), pa.array(starts, pa.int64()), pa.array(lines, pa.string())]
        return spark.createDataFrame(pa.table(columns, ["source", "source_idx", "line_no", "byte_offset", "raw"]), STDIN_SCHEMA)

    for line in stream:
        if held >= STDIN_CHARS:
            path = path or _shared_folder(spark)
            batch().coalesce(1).write.mode("append").parquet(path)
            lines, starts, held = [], [], 0
        raw = line.removesuffix("\n")
        lines.append(raw.removesuffix("\r"))
        starts.append(at)
        at += len(raw.encode()) + 1
        number, held = number + 1, held + len(line) + LINE_CHARS
    if not path:
        return batch()
    batch().coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(STDIN_SCHEMA).parquet(path)
