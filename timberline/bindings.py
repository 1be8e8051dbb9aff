"""The driver's tables as log lines, and as a log file."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.parse import severity_name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as lines: event_id, user_id, event_type, ts, severity_rank, severity, message, raw."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kind = F.col("event_type")
    rank = F.when(kind == "error", F.when(F.col("value") >= 100, 5).otherwise(4)).when(kind == "signup", 3).when(kind == "view", 1).otherwise(2)
    cents = F.round(F.col("value") * 100).cast("long").cast("string")
    message = F.concat(
        F.lit("user="), F.col("user_id").cast("string"), F.lit(" type="), kind, F.lit(" cents="), cents, F.lit(" k="), F.get_json_object("props", "$.k"),
    )
    rows = e.select("event_id", "user_id", "event_type", "ts", rank.alias("severity_rank"), severity_name(rank).alias("severity"), message.alias("message"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rows.withColumn("raw", F.concat_ws(" ", stamp, "severity", "message"))


def plain_time(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps without zone at a query's end, as the tables have them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


_files: dict[tuple, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors see at one path: below spark.checkpoint.dir, or in local mode a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = shared.removeprefix("file://") if shared else None
    if folder:
        os.makedirs(folder, exist_ok=True)
    out = tempfile.mkdtemp(prefix="timberline-log-", dir=folder)
    atexit.register(shutil.rmtree, out, ignore_errors=True)
    return out


def log_file(spark: SparkSession, sf_dir: str) -> str:
    """The path of a log file with the raw lines of log_lines() in their order; written once a session and table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _files:
        folder = scratch(spark)
        # one file is one task's: sorted there, with spilling
        log_lines(spark, sf_dir).select("ts", "event_id", "raw").repartition(1).sortWithinPartitions("ts", "event_id").select("raw").write.text(f"file://{folder}/out")
        part = next(n for n in sorted(os.listdir(f"{folder}/out")) if n.startswith("part-"))
        os.replace(f"{folder}/out/{part}", f"{folder}/events.log")
        _files[key] = f"{folder}/events.log"
    return _files[key]
