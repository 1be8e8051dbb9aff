"""What several corpus operators need: shared storage, skew-proof joins, text kernels."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}
_collected: dict[str, float] = {}

# A key that holds more than 1/HOT_SHARE of the rows is hot; so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 200
# A hot key's rows are dealt out to so many tasks at most.
MOST_SALTS = 1024
# The driver's garbage is collected after a write, but not more often than that.
GC_SECONDS = 10.0
# Text bytes that one numpy step works on.
CHUNK_BYTES = 1 << 18
# An Arrow batch holds at most so many bytes and rows.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode a temporary one will do."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="timberline-")
        atexit.register(shutil.rmtree, _own_dir[app], ignore_errors=True)
    return _own_dir[app]


@contextlib.contextmanager
def _set(spark: SparkSession, key: str, value: str):
    """A session setting for a while; one that this release doesn't know is left alone."""
    was = spark.conf.get(key, None)
    try:
        spark.conf.set(key, value)
    except Exception:
        yield
        return
    try:
        yield
    finally:
        spark.conf.set(key, was) if was is not None else spark.conf.unset(key)


def write(df: DataFrame, path: str) -> None:
    """df as Parquet at path. What was shuffled for it is deleted when it stands: nothing reads that again.

    What executors hold of past jobs (broadcast tables, models and task code, some 100 KB a stage) is freed by Spark once
    the driver's JVM has found its own references dead. Operators here run many short jobs, and the driver seldom has to
    collect its garbage; so that is asked for, as ``spark.cleaner.periodicGC.interval`` does, but each GC_SECONDS.
    """
    spark = df.sparkSession
    with _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    if time.monotonic() - _collected.get("at", -GC_SECONDS) >= GC_SECONDS:
        _collected["at"] = time.monotonic()
        spark.sparkContext._jvm.System.gc()


def free_executors(spark: SparkSession) -> None:
    """Executors give the heap that no object needs any more back to the system, and free what past jobs have left there.

    A JVM keeps the heap it once had committed until it collects all of its garbage, which a large heap may never need;
    Python workers need memory beside it. The driver collects first, so that executors drop its dead broadcasts. A task a
    core has executors collect theirs. In local mode there is but one JVM.
    """
    spark.sparkContext._jvm.System.gc()
    _collected["at"] = time.monotonic()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        cores = spark.sparkContext.defaultParallelism
        spark.range(0, cores, 1, cores).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def spill(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors. Gone when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    write(df, path)
    until_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spilled = path
    return out


def drop(*spilled: DataFrame) -> None:
    """Deletes what spill() wrote, once nothing will read it any more."""
    for df in spilled:
        delete(df.sparkSession, df._spilled)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's file system for that path."""
    p, fs = _file_system(spark, path)
    fs.delete(p, True)


def until_exit(spark: SparkSession, path: str) -> None:
    """A folder that is there is deleted when the driver ends."""
    p, fs = _file_system(spark, path)
    fs.deleteOnExit(p)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of this session are bounded in bytes and rows from now on, so that long texts don't fill a worker.

    The setting has to be there when a returned frame runs, so it stays; a smaller bound that is set already is kept.
    """
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        try:
            now = int(spark.conf.get(key, str(most)))
        except ValueError:  # with a unit: the release's own bound
            now = 0
        if now <= 0 or now > most:
            with contextlib.suppress(Exception):  # a release without the setting
                spark.conf.set(key, str(most))


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int, counts: DataFrame | None = None) -> DataFrame:
    """Inner join of left with right, where right has one row a key and ``count`` is that key's number of left rows.

    A key with more than total / HOT_SHARE rows is hot; there are fewer than HOT_SHARE such keys. Its left rows are dealt
    out by a hash of the whole row, and its right row is repeated for each of these parts: as many parts as the key has
    times total / HOT_SHARE rows, at least 2. Both sides are shuffled; only the hot keys themselves are broadcast, never
    the other columns. ``count`` is dropped. Whether there is a hot key is looked up first, in ``counts`` (right, if not
    given), which should be a written table.
    """
    limit = max(1, total) / HOT_SHARE
    known = right if counts is None else counts
    is_hot = F.col(count) > F.lit(limit)
    if known.filter(is_hot).isEmpty():
        return left.join(right.drop(count), keys)
    parts = F.least(F.lit(MOST_SALTS), F.greatest(F.lit(2), F.ceil(F.col(count) / F.lit(limit)))).cast("int")
    hot = F.broadcast(known.filter(is_hot).select(*keys, parts.alias("__tl_parts")))  # fewer than HOT_SHARE rows of keys
    plain = [c for c, t in left.dtypes if not t.startswith("map")]
    dealt = left.join(hot, keys, "left").withColumn("__tl_salt", F.when(F.col("__tl_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*plain), F.col("__tl_parts"))).cast("int")).drop("__tl_parts")
    repeats = F.when(is_hot, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))
    each = right.withColumn("__tl_salt", F.explode(repeats)).drop(count)
    return dealt.join(each, [*keys, "__tl_salt"]).drop("__tl_salt")


def give_back() -> None:
    """Memory that this Python worker has freed goes back to the system: workers are kept, and others' stages follow."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run):
    """A function of mapInArrow that gives its memory back at the end of each task."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


# --- text kernels -------------------------------------------------------------------------------------------------

_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = []
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_P ** i and _P ** -i modulo 2 ** 64, for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        out = []
        for base in (_P, pow(_P, -1, 1 << 64)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
        _POWERS[:] = out
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a column, and where each begins (one more than texts). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(at: np.ndarray, most: int = CHUNK_BYTES, rows: int = 2048):
    """Ranges of texts with about ``most`` bytes together; a longer text stands alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = int(np.searchsorted(at, at[i] + most, side="right")) - 1
        j = min(max(j, i + 1), i + rows, n)
        yield i, j
        i = j


def word_hashes(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (run of bytes without ASCII white space), and where each text's words begin."""
    n, texts = len(buf), len(at) - 1
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64)
    power, inverse = _powers(n + 1)
    solid = ~IS_SPACE[buf]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = at[:-1][at[:-1] < n]
    first[edges] = solid[edges]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends = at[1:][at[1:] > 0] - 1
    last[ends] = solid[ends]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[buf] * power[:n], out=total[1:])
    return mix((total[e] - total[s]) * inverse[s]), np.searchsorted(s, at).astype(np.int64)


_LANES = np.array([pow(_P, 2 * i + 3, 1 << 64) for i in range(64)], np.uint64)
HASH_BITS = 52


def shingles(buf: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of ``width`` words of each text, sorted: hash, count, where each text's begin.

    A text with fewer words, but at least one, has one shingle of all its words. At most 4096 texts a call.
    """
    words, woff = word_hashes(buf, at)
    texts, n = len(at) - 1, len(words)
    counts = np.diff(woff)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(texts + 1, np.int64)
    grams = np.zeros(n, np.uint64)
    for j in range(width):
        grams[: n - j] += words[j:] * _LANES[j]
    place = np.arange(n) - np.repeat(woff[:-1], counts)
    left = np.repeat(counts, counts) - place
    valid = left >= width
    for d in np.flatnonzero((counts > 0) & (counts < width)):
        a, b = woff[d], woff[d + 1]
        grams[a] = (words[a:b] * _LANES[: b - a]).sum(dtype=np.uint64)
        valid[a] = True
    owner = np.repeat(np.arange(texts, dtype=np.uint64), counts)[valid]
    key = (owner << np.uint64(HASH_BITS)) | (mix(grams[valid]) >> np.uint64(64 - HASH_BITS))
    key.sort()
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    where = np.flatnonzero(fresh)
    key = key[where]
    tf = np.diff(np.append(where, len(fresh)))
    off = np.searchsorted(key >> np.uint64(HASH_BITS), np.arange(texts + 1, dtype=np.uint64)).astype(np.int64)
    return key & np.uint64((1 << HASH_BITS) - 1), tf, off
