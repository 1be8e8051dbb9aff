from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from timberline.functions.parse import parse_lines, parse_timestamp
from timberline.functions.regex import around_group, to_java
from timberline.schema import RANK, severity_rank_of


def _parse(spark, *raw, **options):
    return parse_lines(spark.createDataFrame([(r,) for r in raw], "raw string"), **options).collect()


def test_lines(spark):
    got = _parse(
        spark, "2024-01-15T10:23:45Z INFO server started on port 8080", "2023-06-01 09:00:00 ERROR connection refused\r\n",
        "2022/12/31 23:59:59 DEBUG tick", "2024-01-15T10:00:00+02:00 WARNING   spaced", "2024-01-15T10:00:00Z FATAL ",
    )
    assert [(r["severity"], r["severity_rank"], r["message"]) for r in got] == [
        ("INFO", 2, "server started on port 8080"), ("ERROR", 4, "connection refused"), ("DEBUG", 1, "tick"), ("WARN", 3, "spaced"), ("FATAL", 5, ""),
    ]
    assert got[3]["ts"] == datetime(2024, 1, 15, 8) and got[3]["tz_offset"] == "+02:00" and got[0]["tz_offset"] == "Z"


def test_rejected_lines(spark):
    bad = ["", "just some random text", "not-a-date INFO message", "2024-01-15T10:00:00Z TRACE something", "2024-01-15T10:00:00Z info x", "2024-01-15T10:00:00Z INFO", "T INFO ERROR x", None]
    assert _parse(spark, *bad) == []
    assert [r["ts"] for r in _parse(spark, *bad, keep_bad=True)] == [None] * len(bad)


@pytest.mark.parametrize(
    "text,want",
    [
        ("2024-01-15T10:23:45.123456789Z", datetime(2024, 1, 15, 10, 23, 45, 123456)), ("2024-01-15 9:23:45,5", datetime(2024, 1, 15, 9, 23, 45, 500000)),
        ("2024-01-15T10:23:45-01:30", datetime(2024, 1, 15, 11, 53, 45)), ("2024/01/15T10:00:00", None), ("2024-01-15 10:00:00Z", None),
        ("2024-02-30T10:00:00Z", None), ("2024-01-15T24:00:00Z", None), ("2024-01/15 10:00:00", None),
    ],
)
def test_timestamps(spark, text, want):
    assert spark.range(1).select(parse_timestamp(F.lit(text))).first()[0] == want


def test_severities():
    assert [severity_rank_of(s, strict=False) for s in ("DEBUG", "INFO", "WARN", "WARNING", "ERROR", "FATAL", "TRACE", "")] == [1, 2, 3, 3, 4, 5, 0, 0]
    assert RANK["UNKNOWN"] == 0
    with pytest.raises(ValueError):
        severity_rank_of("TRACE")


def test_patterns(spark):
    p = to_java(r"(?P<a_b>\w+)\s(x|y)$")
    assert p.names == ("a_b", "")
    found = lambda pattern, s: spark.range(1).select(F.lit(s).rlike(to_java(pattern).text)).first()[0]
    assert found(r"a$", "ba") and not found(r"a$", "ba\n") and found(r"a.b", "a\rb") and not found(r"a.b", "a\nb")
    assert not found(r"a\sb", "a\x0bb") and found(r"[\s,]", "\t") and found(r"[[:digit:]]", "3") and found("(?i)ERROR", "an error") and found(r"[[]", "[")
    for bad in (r"(?=a)", r"(a)\1", r"\C", "(", "[a", "a\\", "(?U)a", "*a"):
        with pytest.raises(ValueError):
            to_java(bad)


def test_groups():
    assert around_group(r"a=(\S+)b") == ("a=", r"\S+", "b")
    assert around_group(r"(?:x)(?P<n>y)\(") == ("(?:x)", "y", r"\(")
    assert around_group(r"(a)+") is None and around_group(r"(a)|b") is None
    for bad in ("abc", "(a)(b)"):
        with pytest.raises(ValueError):
            around_group(bad)
