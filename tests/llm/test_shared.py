"""Shared storage, joins with hot keys, settings."""

import os
import subprocess
import sys
import types
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from timberline.llm import _shared as S


def _sides(spark):
    """Half of all rows share a key, others have few rows each; some keys are null or on one side only; one row is repeated."""
    left = [(1 if i % 2 else i % 50, i, f"v{i}") for i in range(1000)] + [(1, 1, "v1")] * 30 + [(None, 5, "x"), (777, 6, "y")]
    sizes = Counter(k for k, _, _ in left if k is not None)
    right = [(k, f"right of {k}", n) for k, n in sizes.items() if k != 777] + [(888, "nothing left", 0)]
    return left, right, spark.createDataFrame(left, "k long, a long, v string"), spark.createDataFrame(right, "k long, r string, n long")


@pytest.mark.parametrize("share", [200, 10, 3, 1])
def test_join_unique_is_a_join(spark, monkeypatch, share):
    monkeypatch.setattr(S, "HOT_SHARE", share)
    left, right, dl, dr = _sides(spark)
    by = {k: r for k, r, _ in right}
    got = S.join_unique(dl, dr, ["k"], "n", len(left))
    assert got.columns == ["k", "a", "v", "r"]
    assert Counter(map(tuple, got.collect())) == Counter((k, a, v, by[k]) for k, a, v in left if k in by)


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    """No task gets much more than total / HOT_SHARE rows of a key, and no column but the key is broadcast."""
    monkeypatch.setattr(S, "HOT_SHARE", 20)
    left, _, dl, dr = _sides(spark)
    joined = S.join_unique(dl, dr, ["k"], "n", len(left))
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "__tl_salt" in plan and "strategy=broadcast" in plan
    salted = dl.filter("k = 1").select(F.pmod(F.xxhash64("k", "a", "v"), F.lit(11)).alias("s")).groupBy("s").count().agg(F.max("count")).first()[0]
    assert salted < 0.25 * len(left)


def test_spills(spark):
    """A spill is a written table; dropping it deletes it; the session's settings are as before."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    df = S.spill(spark.range(10).withColumn("x", F.lit(None).cast("string")).repartition(3), "test")
    assert df.count() == 10 and df.schema.simpleString() == "struct<id:bigint,x:string>"
    path = df._spilled.removeprefix("file://")
    assert os.path.isdir(path) and spark.conf.get(key, None) == was
    S.drop(df)
    assert not os.path.exists(path)


def test_a_cluster_needs_a_shared_folder():
    conf = types.SimpleNamespace(get=lambda *_: None)
    for master, fails in (("spark://host:7077", True), ("yarn", True), ("local-cluster[2,1,1024]", True), ("local[4]", False), ("local", False)):
        session = types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master=master, applicationId=f"test-{master}"))
        if fails:
            with pytest.raises(ValueError, match="spark.checkpoint.dir"):
                S.shared_dir(session)
        else:
            assert os.path.isdir(S.shared_dir(session))
    conf.get = lambda *_: "viewfs://shared/folder/"
    assert S.shared_dir(session) == "viewfs://shared/folder"


_CLUSTER = """
import re, psutil
from pyspark.sql import SparkSession
from timberline.llm._shared import free_executors

spark = SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.executor.memory", "1g").config("spark.ui.enabled", "false").getOrCreate()


def held():
    procs = [p for p in psutil.Process().children(recursive=True) if "CoarseGrainedExecutorBackend" in " ".join(p.cmdline())]
    return sum(int(x) for p in procs for x in re.findall(r"\\nPss_Anon:\\s+(\\d+)", open(f"/proc/{p.pid}/smaps_rollup").read())) // 1024


for _ in range(2):
    spark.range(2_000_000).selectExpr("id", "repeat(cast(id as string), 12) as t").repartition(2).sortWithinPartitions("t").write.format("noop").mode("overwrite").save()
full = held()
free_executors(spark)
free_executors(spark)
print("MB", full, held())
"""


def test_executors_give_memory_back(tmp_path):
    pytest.importorskip("psutil")
    env = os.environ | {"TMPDIR": str(tmp_path), "SPARK_LOCAL_DIRS": str(tmp_path), "PYTHONPATH": str(Path(__file__).resolve().parents[2])}
    done = subprocess.run([sys.executable, "-c", _CLUSTER], env=env, capture_output=True, text=True, timeout=300)
    full, left = map(int, done.stdout.split("MB ")[1].split())
    assert full > 500 and left < full - 150, (full, left)


def test_smaller_batches_of_the_session_are_kept(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    try:
        for now, then in (("10", "10"), ("10000", str(S.BATCH_ROWS)), ("0", str(S.BATCH_ROWS))):
            spark.conf.set(key, now)
            S.bound_batches(spark)
            assert spark.conf.get(key) == then
    finally:
        spark.conf.set(key, was)
