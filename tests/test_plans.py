import io
import time

import pytest
from helpers import at
from pyspark.sql import functions as F

from timberline.functions.parse import parse_lines
from timberline.operators import ordered
from timberline.plans import cli
from timberline.plans.config import Config, from_args, parse_time
from timberline.plans.logframe import LogFrame
from timberline.plans.pipeline import process, slice_lines
from timberline.plans.runctx import Cancelled, RunContext, TimedOut

TEXT = "2024-01-15T10:00:00Z INFO one\n2024-01-15T10:01:00Z WARN two\n\ngarbage\n2024-01-15T10:02:00Z ERROR three\n"


def _raw(spark, *rows):
    return spark.createDataFrame([("f", i, r) for i, r in enumerate(rows)], "source string, line_no long, raw string")


def test_slice(spark):
    df = _raw(spark, *TEXT.splitlines())
    assert [r["message"] for r in slice_lines(df, least="WARN").orderBy("line_no").collect()] == ["two", "three"]
    assert slice_lines(df, parse_time("2024-01-15T10:00:30"), parse_time("2024/01/15 10:01:30")).count() == 1


@pytest.mark.parametrize("rows_of_a_range", [400_000, 5])
def test_pipeline_order(spark, monkeypatch, rows_of_a_range):
    monkeypatch.setattr(ordered, "RANGE_ROWS", rows_of_a_range)
    rows = [f"2024-01-15T10:00:{i // 2:02d}Z {'INFO' if i % 5 else 'DEBUG'} message number {'a' if i < 10 else i}" for i in range(40)]
    df = parse_lines(_raw(spark, *rows))
    got = process(df, Config(min_severity="INFO", dedupe=True, sample_rate=2, rate_limit=1, max_line_len=30), keys=("line_no", "message")).orderBy("line_no").collect()
    kept = [(i, r) for i, r in enumerate(rows) if " INFO " in r]
    stream, last, more, head = [], None, 0, None
    for i, r in kept:
        m = r.split(" ", 2)[2]
        if m == last:
            more += 1
            continue
        if more:
            stream.append((head, f"{last} [repeated {more} time(s)]"))
        stream.append((i, m))
        last, more, head = m, 0, i
    sampled = [x for n, x in enumerate(stream, 1) if n % 2 == 0]
    out, used = [], set()
    for i, m in sampled:
        if i // 2 not in used:
            used.add(i // 2)
            out.append((i, m))
    assert [(r["line_no"], r["message"]) for r in got] == out
    assert all(len(r["raw"]) <= 30 for r in got)


def test_config():
    c, files = from_args(["--since", "2024-01-15T10:00:00", "--to", "2024-01-16 00:00:00", "--level", "WARN", "--format", "json", "a.log"])
    assert c.min_severity == "WARN" and c.output_format == "json" and files == ["a.log"] and c.since == parse_time("2024-01-15T10:00:00Z")
    for bad in (dict(since=at(0), until=at(0)), dict(rate_limit=-1), dict(min_severity="LOUD"), dict(output_format="xml"), dict(tail_n=-1)):
        with pytest.raises(ValueError):
            Config(**bad).validate()
    Config(min_severity="LOUD", strict=False).validate()
    with pytest.raises(ValueError):
        parse_time("15 Jan")


def test_cli(spark, tmp_path):
    p = tmp_path / "a.log"
    p.write_text(TEXT)
    out, err = io.StringIO(), io.StringIO()
    assert cli.run(["--severity", "WARN", "--stats", str(p)], out, err, spark) == 2
    assert out.getvalue() == "2024-01-15T10:01:00Z WARN two\n2024-01-15T10:02:00Z ERROR three\n"
    assert "lines read: 3, matched: 2" in err.getvalue()
    out = io.StringIO()
    assert cli.run(["--tail", "1", "--format", "json"], out, err, spark, io.StringIO(TEXT)) == 1
    assert out.getvalue() == '{"timestamp":"2024-01-15T10:02:00Z","severity":"ERROR","message":"three"}\n'


def test_logframe(spark, tmp_path):
    (tmp_path / "a.log").write_text(TEXT)
    f = LogFrame.read(spark, str(tmp_path / "a.log")).parse()
    assert f.min_severity("WARN").grep("t").df.count() == 2 and {r["severity"] for r in f.counts().collect()} == {"INFO", "WARN", "ERROR"}
    f.dedupe().write(str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 3
    assert f.sample(3).df.first()["message"] == "three" and f.tail(1).df.count() == 1


def test_run_context(spark):
    with RunContext(spark) as c:
        c.set("a", "1")
        snap = c.snapshot()
        snap["a"] = "2"
        assert c.get("a") == "1" and c.get("b") is None and c.err() is None and c.elapsed() >= 0
        c.cancel()
        assert isinstance(c.err(), Cancelled) and c.done().is_set()
    with RunContext(spark, timeout=2) as c:
        with pytest.raises(Exception):
            spark.range(1 << 36).select(F.sum(F.sqrt("id"))).collect()
        time.sleep(0.2)
        assert isinstance(c.err(), TimedOut)
