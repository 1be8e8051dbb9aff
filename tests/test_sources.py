import gzip
import io
import os
import time
from datetime import datetime, timedelta, timezone

import pytest
from helpers import lines
from pyspark.sql import functions as F

from timberline.operators.detect import Rule
from timberline.plans.indexed import IndexedLog
from timberline.plans.logframe import LogFrame
from timberline.sources import lines as lines_
from timberline.sources import logfile, sinks, spots, stores
from timberline.sources.lines import from_stdin, read_lines, source_sizes


def _expected(data: bytes):
    out, at = [], 0
    parts = data.split(b"\n")
    for i, x in enumerate(parts[:-1] if not parts[-1] else parts):
        out.append((i, at, x.rstrip(b"\r").decode()))
        at += len(x) + 1
    return out


def _got(df):
    return sorted((r["line_no"], r["byte_offset"], r["raw"]) for r in df.collect())


@pytest.mark.parametrize("data", [b"one\ntwo\r\n\xc3\xa9\xc3\xa9\n\nlast", b"a\n", b"only"])
def test_line_positions(spark, tmp_path, data):
    (tmp_path / "a.log").write_bytes(data)
    assert _got(read_lines(spark, str(tmp_path / "a.log"))) == _expected(data)


def test_blocks(spark, tmp_path):
    data = b"".join(b"line %d %s\n" % (i, b"x" * (i % 37)) for i in range(5000))
    (tmp_path / "big.log").write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        df = read_lines(spark, str(tmp_path / "big.log"))
        assert _got(df) == _expected(data)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_gzip_and_order(spark, tmp_path):
    data = b"x\ny\n"
    (tmp_path / "a.gz").write_bytes(gzip.compress(data))
    (tmp_path / "b.log").write_bytes(gzip.compress(data))
    (tmp_path / "c.log").write_bytes(data)
    df = read_lines(spark, [str(tmp_path / n) for n in ("c.log", "a.gz", "b.log")])
    assert sorted((r["source_idx"], r["line_no"], r["raw"]) for r in df.collect()) == [(i, n, t) for i in range(3) for n, t in enumerate("xy")]
    assert source_sizes(spark, str(tmp_path / "c.log")).first()["bytes"] == 4


def test_paths_patterns_and_folders(spark, tmp_path):
    """Folders, patterns, odd names and repeated paths; source_idx is the place in the list."""
    deep = tmp_path / "logs" / "2024"
    deep.mkdir(parents=True)
    (tmp_path / "logs" / "_skip").write_text("no\n")
    names = ["a b+c%41.log", "b[1].log", "c{x}.log", "d.log.gz"]
    for i, n in enumerate(names):
        data = f"line of {i}\n".encode()
        (deep / n).write_bytes(gzip.compress(data) if n.endswith("gz") else data)
    (tmp_path / "logs" / "z*.log").write_text("star\n")
    rows = lambda paths: sorted((r["source_idx"], r["line_no"], r["raw"]) for r in read_lines(spark, paths).collect())
    assert rows(str(tmp_path / "logs")) == [(0, 0, "line of 0"), (1, 0, "line of 1"), (2, 0, "line of 2"), (3, 0, "line of 3"), (4, 0, "star")]
    assert rows([str(tmp_path / "logs" / "z*"), str(deep / "*.gz"), str(deep)]) == [(0, 0, "star"), (1, 0, "line of 3"), (2, 0, "line of 0"), (3, 0, "line of 1"), (4, 0, "line of 2")]
    many = tmp_path / "many"
    many.mkdir()
    for i in range(300):
        (many / f"{i:03d}.log").write_text(f"{i}\n")
    assert rows(str(many / "*")) == [(i, 0, str(i)) for i in range(300)]
    with pytest.raises(FileNotFoundError):
        read_lines(spark, str(tmp_path / "none*"))


def test_hidden_gzip_goes_in_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lines_, "BATCH_LINES", 7)
    data = b"".join(b"line %d \xc3\xa9\r\n" % i for i in range(50)) + b"\nno end"
    for n in (0, 7, 50):
        (tmp_path / f"{n}.log").write_bytes(gzip.compress(b"".join(data.splitlines(True)[:n])))
    (tmp_path / "whole.log").write_bytes(gzip.compress(data))
    assert _got(read_lines(spark, str(tmp_path / "whole.log"))) == _expected(data)
    assert read_lines(spark, [str(tmp_path / f"{n}.log") for n in (0, 7, 50)]).count() == 57


def _timed(n, bad=()):
    return b"".join(b"garbage %d\n" % i if i in bad else b"2024-01-15T%02d:%02d:%02dZ INFO number %d\n" % (i // 7200, i // 120 % 60, i // 2 % 60, i) for i in range(n))


def test_tail_and_rewind_read_chunks(spark, tmp_path):
    """The same lines whatever the chunk; a few chunks are read of a large file."""
    data = _timed(20000)
    (tmp_path / "a.log").write_bytes(data)
    (tmp_path / "open.log").write_bytes(data + b"no newline")
    (tmp_path / "empty.log").write_bytes(b"")
    path, want = str(tmp_path / "a.log"), _expected(data)
    pairs = lambda df: sorted((r["byte_offset"], r["raw"]) for r in df.collect())
    for chunk in (16, 1000, 65536):
        assert pairs(spots.tail(spark, path, 5, chunk)) == [x[1:] for x in want[-5:]]
        for end in (want[100][1], want[100][1] + 1, want[100][1] - 1, 1):
            assert pairs(spots.rewind(spark, path, end, 3, chunk)) == [x[1:] for x in want if x[1] < end][-3:]
    assert pairs(spots.tail(spark, str(tmp_path / "open.log"), 2))[1][1] == "no newline"
    assert pairs(spots.tail(spark, path, 10**6)) == [x[1:] for x in want] and pairs(spots.tail(spark, str(tmp_path / "empty.log"), 5)) == []
    assert pairs(spots.rewind(spark, path, 10**9, 2)) == [x[1:] for x in want[-2:]] and pairs(spots.rewind(spark, path, 500, 0)) == []
    file = spots.FileBytes(path)
    spots.lines_before(file, file.size, 50, 4096)
    assert file.taken <= 4096 < file.size / 100
    with pytest.raises(ValueError):
        spots.tail(spark, path, 0)


@pytest.mark.parametrize("bad", [(), range(0, 20000, 3), range(4000, 16000)])
def test_seek_reads_a_few_places(spark, tmp_path, bad):
    data = _timed(20000, set(bad))
    (tmp_path / "a.log").write_bytes(data)
    path, lines = str(tmp_path / "a.log"), [(o, r) for _, o, r in _expected(data) if not r.startswith("garbage")]
    for second in (0, 1, 4999, 9000, 9999, 10000):
        target = datetime(2024, 1, 15, tzinfo=timezone.utc) + timedelta(seconds=second)
        want = next((o for o, r in lines if r[:20] >= target.strftime("%Y-%m-%dT%H:%M:%SZ")), None)
        file = spots.FileBytes(path)
        assert spots.seek(spark, path, target, 512, file) == want
        assert bad or file.taken < file.size / 10


def test_indexed_log(spark, tmp_path):
    """The index is built once, reading begins at its floor, and equal times across an entry are not lost."""
    data = b"".join(b"2024-01-15T00:%02d:00Z INFO number %d\n" % (i // 40, i) for i in range(2000))
    (tmp_path / "a.log").write_bytes(data)
    log = IndexedLog(spark, str(tmp_path / "a.log"), every=100)
    assert log.index() is log.index() and log.index().count() == 20
    base = datetime(2024, 1, 15, tzinfo=timezone.utc)
    for minute in (0, 2, 5, 49, 50):
        got = sorted(r["message"] for r in log.since(base + timedelta(minutes=minute)).collect())
        assert got == sorted(f"number {i}" for i in range(2000) if i // 40 >= minute)
    got = log.since(base + timedelta(minutes=10), base + timedelta(minutes=12))
    assert sorted(r["message"] for r in got.collect()) == sorted(f"number {i}" for i in range(400, 520))
    frame = LogFrame.seek(spark, str(tmp_path / "a.log"), base + timedelta(minutes=49)).parse().mask(["number (19)"])
    assert sorted(r["message"] for r in frame.df.collect()) == sorted(f"number [REDACTED]{i - 1900}" if i < 2000 else "" for i in range(1960, 2000))
    assert LogFrame.seek(spark, str(tmp_path / "a.log"), base + timedelta(days=1)).df.count() == 0
    assert LogFrame.last(spark, str(tmp_path / "a.log"), 3).parse().alerts([Rule("INFO", 3, timedelta(minutes=1))]).count() == 1
    assert LogFrame.rewind(spark, str(tmp_path / "a.log"), 1, 5).df.count() == 1


def test_a_batch_of_a_replaced_file_fails(tmp_path):
    p = tmp_path / "a.log"
    p.write_bytes(b"one\n")
    s = logfile.FileStream(str(p), "begin")
    part = s.partitions(s.initialOffset(), s.latestOffset())[0]
    other = tmp_path / "b"
    other.write_bytes(b"two\n")
    os.replace(other, p)
    with pytest.raises(OSError, match="replaced"):
        list(s.read(part))


def test_bad_reads(spark, tmp_path):
    (tmp_path / "a.log").write_text("x" * 100)
    with pytest.raises(ValueError):
        read_lines(spark, [])
    with pytest.raises(Exception, match="too long"):
        read_lines(spark, str(tmp_path / "a.log"), max_line_bytes=50).collect()
    assert [r["raw"] for r in from_stdin(spark, io.StringIO("a\r\nb")).collect()] == ["a", "b"]


@pytest.mark.parametrize("text", ["", "\n", "a", "a\n\nb\r\n", "\ufeffa\r\r\n\u2028 b\n" + "".join(f"é {i}\n" for i in range(300)) + "tail"])
def test_stdin_in_batches(spark, monkeypatch, text):
    """A long stream is never held whole: no batch that leaves the driver's Python has more than STDIN_CHARS and a line."""
    sizes, create = [], type(spark).createDataFrame
    monkeypatch.setattr(lines_, "STDIN_CHARS", 5000)
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: sizes.append(len(data)) or create(self, data, *a, **k))
    got = [tuple(r) for r in from_stdin(spark, io.StringIO(text)).orderBy("line_no").collect()]
    want, at = [], 0
    for i, line in enumerate(text.encode().split(b"\n")[: text.count("\n") + (text[-1:] not in ("\n", ""))]):
        want.append(("-", 0, i, at, line.removesuffix(b"\r").decode()))
        at += len(line) + 1
    assert got == want and max(sizes) <= 50 and sum(sizes) == len(want)


def test_batch_reader(spark, tmp_path, monkeypatch):
    data = b"".join(b"line %d\n" % i for i in range(100)) + b"tail"
    p = tmp_path / "a.log"
    p.write_bytes(data)
    for split in (7, 64, 1 << 20):
        monkeypatch.setattr(logfile, "SPLIT", split)
        for offset in (0, 7, 14, len(data)):
            r = logfile.FileReader(str(p), offset)
            got = [x[1:] for part in r.partitions() for x in r.read(part)]
            assert got == [(at, t) for _, at, t in _expected(data) if at >= offset]
    logfile.register(spark)
    assert spark.read.format("logfile").option("path", str(p)).option("offset", 14).load().count() == 99


def test_stream_reader_and_rotation(tmp_path):
    p = tmp_path / "a.log"
    p.write_bytes(b"old\n")
    s = logfile.FileStream(str(p), "end")
    a = s.initialOffset()
    with p.open("ab") as f:
        f.write(b"new\npart")
    b = s.latestOffset()
    read = lambda a, b: [t for part in s.partitions(a, b) for _, _, t in s.read(part)]
    assert read(a, b) == ["new"]
    with p.open("ab") as f:
        f.write(b"ial\n")
    c = s.latestOffset()
    assert read(b, c) == ["partial"]
    os.rename(p, tmp_path / "a.1")
    assert s.latestOffset() == c
    p.write_bytes(b"fresh\n")
    d = s.latestOffset()
    assert read(c, d) == ["fresh"]
    w = logfile.Watch(str(p))
    assert not w.rotated()
    p.write_bytes(b"")
    assert w.rotated() and not w.rotated()
    other = tmp_path / "other"
    other.write_bytes(b"longer than before")
    os.replace(other, p)
    assert w.rotated()


def test_stores(tmp_path):
    s = stores.OffsetStore(tmp_path / "o.json")
    with pytest.raises(stores.NoOffset):
        s.get("k")
    s.put("k", 5, 9)
    assert stores.OffsetStore(tmp_path / "o.json").get("k") == (5, 9)
    s.delete("k")
    with pytest.raises(stores.NoOffset):
        stores.OffsetStore(tmp_path / "o.json").get("k")
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ValueError):
        stores.OffsetStore(tmp_path / "bad.json")
    c = stores.CheckpointStore(tmp_path / "deep/dir")
    assert c.load("/a/x.log") is None
    c.save(stores.Checkpoint("/a/x.log", 3))
    c.save(stores.Checkpoint("/b/x.log", 4))
    assert c.load("/a/x.log").offset == 3 and c.load("/b/x.log").offset == 4 and c.load("/a/x.log").saved_at
    c.delete("/a/x.log"), c.delete("/a/x.log")
    assert c.load("/a/x.log") is None
    with pytest.raises(ValueError):
        c.save(None)


def test_index_cache(spark, tmp_path):
    now = [0.0]
    cache = stores.IndexCache(10, clock=lambda: now[0])
    df = spark.range(3)
    cache.put("p", 5, 1.0, df)
    assert cache.get("p", 5, 1.0) is df and cache.get("p", 6, 1.0) is None and cache.get("p", 5, 2.0) is None and len(cache) == 1
    now[0] = 11
    assert cache.get("p", 5, 1.0) is None
    cache.invalidate("p"), cache.invalidate("p")
    assert len(cache) == 0
    p = tmp_path / "f"
    p.write_text("x")
    built = []
    w = stores.Warmer(cache, lambda path: built.append(path) or spark.range(2))
    assert w.warm(str(p)) is w.warm(str(p)) and len(built) == 1
    broken = stores.Warmer(stores.IndexCache(10), lambda path: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        broken.warm(str(p))
    assert len(broken.cache) == 0


def test_sinks(spark, tmp_path):
    df = lines(spark, [(2, "INFO", "b"), (1, "WARN", "a")])
    sinks.write_text(df, str(tmp_path / "raw"), keys=("ts",))
    assert [r[0] for r in spark.read.text(str(tmp_path / "raw")).collect()] == ["WARN a", "INFO b"]
    sinks.write_text(df, str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json")).columns == ["message", "severity", "timestamp"]
    sinks.write_buckets(df, str(tmp_path / "b"), F.col("severity"))
    assert sorted(os.listdir(tmp_path / "b"))[-2:] == ["bucket=INFO", "bucket=WARN"]
    with pytest.raises(ValueError):
        sinks.write_text(df, str(tmp_path / "x"), "xml")
    assert time.time()
