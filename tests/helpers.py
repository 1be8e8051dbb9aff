"""Random log streams for comparing batch operators with folds."""

import random
from datetime import datetime, timedelta, timezone

BASE = datetime(2024, 1, 15, 12, tzinfo=timezone.utc)
SCHEMA = "source string, line_no long, ts timestamp, severity string, message string, raw string"


def at(seconds):
    return BASE + timedelta(seconds=seconds)


def lines(spark, rows):
    """rows: (seconds or None, severity, message) of one source."""
    data = [("f", i, None if s is None else at(s), sev, m, f"{sev} {m}") for i, (s, sev, m) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def random_rows(seed, n=300, nulls=0.0, ordered=True):
    rng = random.Random(seed)
    times = [rng.randrange(0, n // 2) for _ in range(n)]
    if ordered:
        times.sort()
    return [(None if rng.random() < nulls else t, rng.choice(["DEBUG", "INFO", "WARN", "ERROR", "FATAL"]), rng.choice("aab")) for t in times]


def as_dicts(rows):
    us = int(BASE.timestamp()) * 1_000_000
    return [{"source": "f", "line_no": i, "ts_us": None if s is None else us + s * 1_000_000, "severity": sev, "message": m, "raw": f"{sev} {m}"} for i, (s, sev, m) in enumerate(rows)]


def fold_all(fold, rows, flush=None):
    state, out = {}, []
    for r in as_dicts(rows):
        out += [dict(x) for x in fold(state, r)]
    return out + ([dict(x) for x in flush(state)] if flush else [])
