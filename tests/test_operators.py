"""Batch operators against independent folds and the documented examples, in one range and in many."""

from datetime import timedelta

import pytest
from helpers import as_dicts, at, fold_all, lines, random_rows
from pyspark.sql import functions as F

from timberline.operators import aggregate, combine, detect, events, filters, ordered, positions
from timberline.streaming import folds

KEYS = ("ts", "line_no")


@pytest.fixture(params=["one range", "many ranges", "evenly cut ranges"])
def ranges(request, monkeypatch):
    if request.param != "one range":
        monkeypatch.setattr(ordered, "RANGE_ROWS", 20)
    if request.param == "evenly cut ranges":
        monkeypatch.setattr(ordered, "QUANTILES", 5)
        monkeypatch.setattr(ordered, "GROUP", 2)
        monkeypatch.setattr(ordered, "SEND_RANGES", 3)


def test_ranges_are_consecutive(spark, ranges):
    """Every value has one range, ranges are in the order of the values, and hold RANGE_ROWS rows or so."""
    df = spark.range(1000).selectExpr("cast(pow(id, 1.3) as long) as k").repartition(3)
    cut = ordered.Ranges.of(df, F.col("k"))
    got = sorted((r["k"], r["r"]) for r in df.select("k", cut.of_value(F.col("k")).alias("r")).collect())
    assert [r for _, r in got] == sorted(r for _, r in got) and got[-1][1] < len(cut)
    if cut.cuts:
        assert len(cut) >= 40 and max(sum(r == x for _, r in got) for x in {r for _, r in got}) < 300


def nos(df):
    return sorted(r["line_no"] for r in df.collect())


def test_filters(spark):
    df = lines(spark, [(-3600, "DEBUG", "a"), (0, "ERROR", "b"), (3600, "INFO", "c"), (None, "UNKNOWN", "d")]).withColumn("severity_rank", F.when(F.col("severity") == "ERROR", 4).when(F.col("severity") == "UNKNOWN", 0).otherwise(2))
    assert nos(filters.time_range(df, at(-3600), at(0))) == [0, 1] and nos(filters.time_range(df, at(0), at(0))) == [1] and nos(filters.time_range(df)) == [0, 1, 2, 3]
    assert nos(filters.min_severity(df, "WARN")) == [1] and nos(filters.min_severity(df, "DEBUG")) == [0, 1, 2] and nos(filters.min_severity(df, 0)) == [0, 1, 2, 3]
    assert nos(filters.min_severity(df, "LOUD", strict=False)) == [0, 1, 2, 3]
    assert nos(filters.grep(df, "error")) == [] and nos(filters.grep(df, "error", ignore_case=True)) == [1] and nos(filters.grep(df, "ERROR", invert=True)) == [0, 2, 3] and nos(filters.grep(df, "")) == [0, 1, 2, 3]
    assert [filters.grep_name(*x) for x in (("p", False), ("p", True), ("", True))] == ["/p/", "NOT /p/", "<no pattern>"]
    with pytest.raises(ValueError):
        filters.grep(df, "(")


def test_pushdown(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").withColumnRenamed("value", "severity_rank")
    plan = filters.match(df, None, None, 3).select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(value" in plan and "props" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("n", [1, 3, 10])
def test_sample(spark, ranges, n):
    rows = random_rows(1)
    assert nos(events.sample_every(lines(spark, rows), n)) == sorted(r["line_no"] for r in fold_all(folds.sample_every(n), rows))


def test_sample_by_source(spark, ranges):
    df = lines(spark, random_rows(1)).withColumn("source", (F.col("line_no") % 3).cast("string"))
    assert nos(events.sample_every(df, 3, by=("source",))) == [i for i in range(300) if (i // 3 + 1) % 3 == 0]


@pytest.mark.parametrize("seed", [1, 2])
def test_dedupe_runs(spark, ranges, seed):
    rows = random_rows(seed)
    got = sorted((r["line_no"], r["message"]) for r in events.dedupe_runs(lines(spark, rows)).collect())
    assert got == sorted((r["line_no"], r["message"]) for r in fold_all(folds.dedupe_runs(), rows, folds.flush_runs))


def test_dedupe_example(spark):
    got = events.dedupe_runs(lines(spark, [(0, "INFO", "x")] * 3 + [(0, "INFO", "b")]))
    assert [r["message"] for r in got.orderBy("line_no", "repeats").collect()] == ["x", "x [repeated 2 time(s)]", "b"]
    assert events.dedupe_runs(lines(spark, [])).count() == 0
    by = lines(spark, [(0, "INFO", "x")] * 4).withColumn("source", F.when(F.col("line_no") % 2 == 0, "e"))
    assert sorted(r["repeats"] for r in events.dedupe_runs(by, by=("source",)).collect()) == [0, 0, 1, 1]


def test_dedupe_within(spark, ranges):
    rows = random_rows(3)
    assert nos(events.dedupe_within(lines(spark, rows), 2)) == sorted(r["line_no"] for r in fold_all(folds.dedupe_within(2_000_000), rows))


def test_rate_limit(spark):
    rows = random_rows(4)
    assert nos(events.rate_limit(lines(spark, rows), 1)) == sorted(r["line_no"] for r in fold_all(folds.rate_limit(1), rows))
    df = lines(spark, [(0, "INFO", "x")] * 10)
    assert events.rate_limit(df, 5).count() == 5 and events.rate_limit(df, 0).count() == 10
    with pytest.raises(ValueError):
        events.rate_limit(df, -1)


def test_throttle(spark, ranges):
    got = events.throttle(lines(spark, random_rows(5)), 7).orderBy("line_no").collect()
    assert [r["emit_second"] for r in got] == [i // 7 for i in range(300)]


def test_retain(spark, ranges):
    m = 60
    df = lines(spark, [(0, "INFO", "a"), (m, "INFO", "b"), (3 * m, "INFO", "c"), (4 * m, "INFO", "d")])
    assert nos(events.retain(df, 120)) == [2, 3] and nos(events.retain(df, 0)) == [0, 1, 2, 3]
    assert nos(events.retain(lines(spark, [(0, "INFO", "a"), (m, "INFO", "b")]), 60)) == [0, 1]
    mixed = lines(spark, [(0, "INFO", "old"), (100, "INFO", "new"), (5, "INFO", "stale behind"), (110, "INFO", "last")])
    assert nos(events.retain(mixed, 20, keys=("line_no",))) == [1, 2, 3]


@pytest.mark.parametrize("cap", [0, 1, 2, 3])
def test_coalesce(spark, ranges, cap):
    rows = random_rows(6, nulls=0.5)
    got = sorted((r["line_no"], r["message"]) for r in events.coalesce_events(lines(spark, rows), cap).collect())
    assert got == sorted((r["line_no"], r["message"]) for r in fold_all(folds.coalesce_events(cap), rows, folds.flush_event))


def test_retention_fold():
    rows = [(0, "INFO", "old"), (100, "INFO", "new"), (5, "INFO", "stale behind"), (110, "INFO", "last")]
    assert [r["count"] for r in fold_all(folds.retention(20_000_000), rows)] == [1, 1, 2, 3]
    assert [r["count"] for r in fold_all(folds.retention(0), rows)] == [1, 2, 3, 4]


def test_sequence_and_replay(spark, ranges):
    rows = random_rows(7, nulls=0.2, ordered=False)
    assert [r["seq"] for r in events.sequence(lines(spark, rows)).orderBy("line_no").collect()] == [str(i + 1) for i in range(300)]
    want, prev, total = [], None, 0
    for r in as_dicts(rows):
        if r["ts_us"] is not None:
            total += max(0, r["ts_us"] - prev) if prev is not None else 0
            prev = r["ts_us"]
        want.append(total // 4)
    assert [r["emit_us"] for r in events.replay(lines(spark, rows), 4.0).orderBy("line_no").collect()] == want


@pytest.mark.parametrize("severity,threshold,seconds", [("ERROR", 3, 5), ("WARN", 1, 0), ("FATAL", 8, 30)])
def test_alerts(spark, ranges, severity, threshold, seconds):
    rows = random_rows(8)
    got = detect.alerts(lines(spark, rows), [detect.Rule(severity, threshold, timedelta(seconds=seconds))])
    want = fold_all(folds.threshold_alert(severity, threshold, seconds * 1_000_000), rows)
    assert sorted((r["line_no"], r["count"]) for r in got.collect()) == sorted((r["line_no"], r["count"]) for r in want)


def test_alert_examples(spark):
    rule = detect.Rule("ERROR", 3, timedelta(minutes=1))
    got = detect.alerts(lines(spark, [(0, "ERROR", "a"), (10, "ERROR", "b"), (20, "ERROR", "c")]), [rule]).collect()
    assert [(r["line_no"], r["alert"]) for r in got] == [(2, "alert: ERROR count 3 >= threshold 3 in last 1m0s")]
    assert detect.alerts(lines(spark, [(0, "ERROR", "a"), (5, "ERROR", "b"), (120, "ERROR", "c")]), [detect.Rule("ERROR", 3, timedelta(seconds=30))]).count() == 0
    assert [detect.duration_text(timedelta(seconds=s)) for s in (0, 1.5, 10, 3600, 0.25)] == ["0s", "1.5s", "10s", "1h0m0s", "250ms"]
    multi = detect.multi_alerts(lines(spark, [(0, "ERROR", "a")]), {"x": [detect.Rule("ERROR", 1, timedelta(1))], "y": [detect.Rule("ERROR", 1, timedelta(1)), detect.Rule("WARN", 1, timedelta(1))]})
    assert sorted(r["target"] for r in multi.collect()) == ["x", "y"]


@pytest.mark.parametrize("threshold,seconds", [(3.0, 2), (2.0, 1), (2.0, 0)])
def test_bursts(spark, ranges, threshold, seconds):
    rows = random_rows(9)
    got = detect.bursts(lines(spark, rows), threshold, timedelta(seconds=seconds))
    assert nos(got) == sorted(r["line_no"] for r in fold_all(folds.burst(threshold, seconds * 1_000_000), rows))
    assert detect.bursts(lines(spark, [(0, "INFO", "x")] * 10), 2, timedelta(seconds=1)).count() == 1


def test_buckets(spark):
    df = lines(spark, [(120, "INFO", "a"), (0, "WARN", "b"), (60, "INFO", "c"), (90, "INFO", "d"), (None, "INFO", "e")])
    got = aggregate.bucket_counts(df, timedelta(minutes=1)).orderBy("start").collect()
    assert [(r["start"], r["info"], r["warn"], r["total"]) for r in got] == [(at(0).replace(tzinfo=None), 0, 1, 1), (at(60).replace(tzinfo=None), 2, 0, 2), (at(120).replace(tzinfo=None), 1, 0, 1)]
    assert aggregate.bucket_cardinality(df, timedelta(0)).first()[0] == 3
    assert {r["severity"]: r["n"] for r in aggregate.level_counts(df).collect()} == {"INFO": 4, "WARN": 1} and aggregate.level_total(df).first()[0] == 5
    week = aggregate.bucket_counts(df, timedelta(days=7)).first()["start"]
    assert week.weekday() == 0 and week.hour == 0


def test_split_and_stats(spark):
    df = lines(spark, [(0, "INFO", "a"), (1, "WARN", ""), (2, "INFO", "b")])
    assert sorted(r["bucket"] for r in aggregate.split_keys(df, F.col("message")).collect()) == ["a", "b"]
    assert nos(aggregate.split_bucket(df, F.col("severity"), "INFO")) == [0, 2] and nos(aggregate.split_bucket(df, F.col("severity"), "none")) == []
    assert tuple(aggregate.run_stats(df, F.col("severity") == "INFO").first()) == (3, 2, 17)
    seen_df, seen = aggregate.observe(df, F.col("severity") == "INFO")
    seen_df.count()
    assert seen.get == {"lines_read": 3, "lines_matched": 2, "bytes_read": 17} and "matched: 2" in aggregate.stats_text(seen.get, 1.0)


def test_merge(spark):
    a, b = lines(spark, [(1, "INFO", "a"), (4, "INFO", "c"), (6, "INFO", "e")]), lines(spark, [(2, "INFO", "b"), (3, "INFO", "bb"), (5, "INFO", "d")])
    merged = combine.merge_sorted([a, None, b])
    assert [r["message"] for r in merged.collect()] == ["a", "b", "bb", "c", "d", "e"]
    assert [r["merge_rank"] for r in combine.merge_rank(merged, ("ts", "source_idx", "line_no")).orderBy("ts").collect()] == [1, 2, 3, 4, 5, 6]
    with pytest.raises(ValueError):
        combine.merge_sorted([None])
    bad = lines(spark, [(0, "INFO", "x"), (None, "INFO", "bad"), (9, "INFO", "y")]).withColumn("source_idx", F.lit(0)).unionByName(lines(spark, [(1, "INFO", "z")]).withColumn("source_idx", F.lit(1)))
    assert [r["message"] for r in combine.multifile(bad).collect()] == ["x", "z"] and [r["message"] for r in combine.multifile(bad, "skip").collect()] == ["x", "z", "y"]


def test_fanout(spark):
    got, df = [], lines(spark, [(0, "INFO", "a")])

    def broken(_):
        raise OSError("full")

    f = combine.Fanout(lambda d: got.append(d.count()), None, broken)
    f.add(lambda d: got.append("last"))
    assert len(f) == 3 and [str(e) for e in f.send(df)] == ["full"] and got == [1, "last"]
    with pytest.raises(ExceptionGroup):
        f.batch()(df, 0)


def _offsets(spark, n, bad=()):
    rows = [("f", i, 10 * i, None if i in bad else at(i // 2), "INFO", f"number {i}", "x" * 9) for i in range(n)]
    return spark.createDataFrame(rows, "source string, line_no long, byte_offset long, ts timestamp, severity string, message string, raw string")


def test_tails(spark):
    df = _offsets(spark, 20, bad=(18,))
    assert nos(positions.tail(df, 5)) == [15, 16, 17, 19] and nos(positions.tail(_offsets(spark, 3), 10)) == [0, 1, 2] and nos(positions.tail(_offsets(spark, 0), 5)) == []
    with pytest.raises(ValueError):
        positions.tail(df, 0)
    assert nos(positions.rewind(_offsets(spark, 10), 100, 3)) == [7, 8, 9] and nos(positions.rewind(_offsets(spark, 5), 50, 20)) == [0, 1, 2, 3, 4] and nos(positions.rewind(df, 100, 0)) == []
    assert nos(positions.rewind(df, 50, 2)) == [3, 4] and nos(positions.from_offset(df, 180)) == [18, 19]


@pytest.mark.parametrize("every", [1, 3, 7])
def test_index(spark, ranges, every):
    rows = random_rows(10, nulls=0.2, ordered=False)
    df = lines(spark, rows).withColumn("byte_offset", F.col("line_no") * 10)
    want, top = [], None
    for i, (s, _, _) in enumerate(rows):
        if i % every == 0 and s is not None and (top is None or s > top or i == 0):
            want.append(i)
            top = s
    assert nos(positions.build_index(df, every)) == want


def test_floor_and_seek(spark, ranges):
    index = spark.createDataFrame([(at(0), 0), (at(3600), 1000), (at(3600), 1500), (at(7200), 2000)], "ts timestamp, byte_offset long")
    targets = spark.createDataFrame([(at(s),) for s in (-1, 0, 3600, 5400, 9999)], "target timestamp")
    got = {r["target"]: r["byte_offset"] for r in positions.floor_offset(index, targets).collect()}
    assert [got[at(s).replace(tzinfo=None)] for s in (-1, 0, 3600, 5400, 9999)] == [None, 0, 1500, 1500, 2000]
    df = _offsets(spark, 10)
    assert positions.seek_to_time(df, at(2)).first()[0] == 40 and positions.seek_to_time(df, at(99)).first()[0] is None
