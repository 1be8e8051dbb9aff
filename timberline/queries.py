"""The registered queries over the driver's tables, each beside its DuckDB oracle."""

from __future__ import annotations

import gzip
import io
import os
import shutil
import socket
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.bindings import log_file, log_lines, plain_time, scratch, table
from timberline.functions import maps, parse, text
from timberline.operators import aggregate, combine, detect, events, filters, positions
from timberline.operators.ordered import Stream
from timberline.plans import cli
from timberline.plans.config import Config
from timberline.plans.indexed import IndexedLog
from timberline.plans.pipeline import process, slice_lines
from timberline.sources import lines, logfile, sinks, spots, stores
from timberline.streaming import folds, follow, stateful
from timberline.streaming.stateful import run_fold

KEYS = ("ts", "event_id")
SINCE, UNTIL = datetime(2024, 1, 10, tzinfo=timezone.utc), datetime(2024, 1, 12, tzinfo=timezone.utc)
_RANGE = "ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12'"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
TOKEN = r'token = "([0-9a-f]+)"'

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}

# The log lines of the events table, as SQL.
_L = """l AS (
  SELECT event_id, user_id, event_type, ts, severity_rank, severity, message,
         strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' ' || severity || ' ' || message AS raw
  FROM (SELECT *, ['UNKNOWN','DEBUG','INFO','WARN','ERROR','FATAL'][severity_rank + 1] AS severity,
               'user=' || user_id || ' type=' || event_type || ' cents=' || CAST(round(value * 100) AS BIGINT) || ' k=' || json_extract_string(props, '$.k') AS message
        FROM (SELECT *, CAST(CASE WHEN event_type = 'error' THEN CASE WHEN value >= 100 THEN 5 ELSE 4 END
                              WHEN event_type = 'signup' THEN 3 WHEN event_type = 'view' THEN 1 ELSE 2 END AS INT) AS severity_rank FROM events)))"""
_O = "ORDER BY ts, event_id"


def query(sql: str | None = None, name: str | None = None, raw_sql: bool = False):
    """Registers a function; its oracle is ``sql`` over the log lines l (raw_sql: over the tables alone)."""

    def add(f):
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _ORACLES[key] = sql if raw_sql else f"WITH {_L}, {sql.strip()[5:]}" if sql.strip().upper().startswith("WITH ") else f"WITH {_L} {sql}"
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = log_lines(spark, sf_dir).select("raw")
    severe = filters.match(parse.parse_lines(raw), SINCE, UNTIL, "WARN")
    return plain_time(aggregate.bucket_counts(severe, timedelta(hours=1)), "start")


_QUERIES["flagship"] = flagship
_ORACLES["flagship"] = f"""WITH {_L} SELECT date_trunc('hour', ts) AS start, 0::BIGINT AS unknown, count(*) FILTER (severity = 'DEBUG') AS debug,
    count(*) FILTER (severity = 'INFO') AS info, count(*) FILTER (severity = 'WARN') AS warn, count(*) FILTER (severity = 'ERROR') AS error,
    count(*) FILTER (severity = 'FATAL') AS fatal, count(*) AS total
    FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM l) WHERE {_RANGE} AND severity_rank >= 3 GROUP BY 1"""


# --- scans and parsing --------------------------------------------------------------------------------------------


_OFFSETS = f"o AS (SELECT *, row_number() OVER ({_O}) - 1 AS line_no, CAST(sum(strlen(raw) + 1) OVER ({_O} ROWS UNBOUNDED PRECEDING) AS BIGINT) - strlen(raw) - 1 AS byte_offset FROM l)"


@query(f"WITH {_OFFSETS} SELECT line_no, byte_offset, raw FROM o")
def scan_lines(spark, sf):
    return lines.read_lines(spark, log_file(spark, sf)).select("line_no", "byte_offset", "raw")


@query(f"WITH {_OFFSETS} SELECT source_idx, line_no, byte_offset, raw FROM o, (SELECT unnest([0, 1, 2])::INT AS source_idx)")
def scan_gzip(spark, sf):
    """The log file, compressed under a name that says so, and under one that doesn't."""
    path, folder = log_file(spark, sf), scratch(spark)
    packed, hidden = f"{folder}/events.log.gz", f"{folder}/other.log"
    with open(path, "rb") as plain, gzip.open(packed, "wb", 1) as out:
        shutil.copyfileobj(plain, out, 1 << 20)
    shutil.copyfile(packed, hidden)
    return lines.read_lines(spark, [packed, path, hidden]).select("source_idx", "line_no", "byte_offset", "raw")


@query("SELECT event_id, date_trunc('second', ts) AS ts, 'Z' AS tz_offset, severity, severity_rank, message FROM l")
def parse_lines(spark, sf):
    rows = parse.parse_lines(log_lines(spark, sf).select("event_id", "raw"))
    return plain_time(rows.select("event_id", "ts", "tz_offset", "severity", "severity_rank", "message"), "ts")


@query("SELECT event_id, date_trunc('second', ts) AS ts FROM l")
def parse_timestamp(spark, sf):
    stamp = F.element_at(F.split("raw", " "), 1)
    return plain_time(log_lines(spark, sf).select("event_id", parse.parse_timestamp(stamp).alias("ts")), "ts")


@query("SELECT event_id, severity_rank, severity FROM l")
def severity_rank(spark, sf):
    rank = parse.severity_rank(F.element_at(F.split("raw", " "), 2))
    return log_lines(spark, sf).select("event_id", rank.alias("severity_rank"), parse.severity_name(rank).alias("severity"))


_SCHEMA = maps.LinePattern("event", r"user=(?P<user_id>\d+) type=(?P<kind>\w+)")


@query(r"SELECT event_id, regexp_extract(raw, 'user=(\d+) type=(\w+)', 1) AS user_id, regexp_extract(raw, 'user=(\d+) type=(\w+)', 2) AS kind FROM l")
def schema_match(spark, sf):
    rows = log_lines(spark, sf).withColumn("fields", _SCHEMA.match(F.col("raw"))).filter("fields is not null")
    return rows.select("event_id", F.col("fields")["user_id"].alias("user_id"), F.col("fields")["kind"].alias("kind"))


@query(r"SELECT event_id, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'event' END AS name, CAST(user_id AS VARCHAR) AS user_id FROM l")
def schema_match_first(spark, sf):
    known = maps.PatternRegistry()
    known.register(maps.LinePattern("failure", r"user=(?P<user_id>\d+) type=error"))
    known.register(_SCHEMA)
    rows = log_lines(spark, sf).withColumn("hit", known.match_first(F.col("raw"))).filter("hit is not null")
    return rows.select("event_id", F.col("hit.name").alias("name"), F.col("hit.fields")["user_id"].alias("user_id"))


_KV = "SELECT event_id, split_part(kv, '=', 1) AS key, split_part(kv, '=', 2) AS value FROM (SELECT event_id, unnest(string_split(message, ' ')) AS kv FROM l)"


@query(_KV)
def kv_extract_all(spark, sf):
    return log_lines(spark, sf).select("event_id", F.explode(maps.extract_kv(F.col("message"))))


@query(_KV + " WHERE split_part(kv, '=', 1) IN ('user', 'k')")
def kv_extract_selected(spark, sf):
    return log_lines(spark, sf).select("event_id", F.explode(maps.extract_kv(F.col("message"), "user", "k", "absent")))


@query("SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS message FROM conversations GROUP BY conv_id", raw_sql=True)
def coalesce_events(spark, sf):
    rows = table(spark, sf, "conversations").withColumnRenamed("text", "message")
    first = F.when(F.col("turn") == 0, F.lit(datetime(2024, 1, 1, tzinfo=timezone.utc)))
    rows = rows.select("conv_id", "turn", first.alias("ts"), "message")
    return events.coalesce_events(rows, 0, ("turn", "message"), ("conv_id",)).select("conv_id", "message")


@query("SELECT CAST(sum(strlen(raw) + 1) AS BIGINT) AS bytes FROM l")
def source_size(spark, sf):
    return lines.source_sizes(spark, log_file(spark, sf)).select("bytes")


# --- filters ------------------------------------------------------------------------------------------------------

_COLS = "event_id, ts, severity, message"


def _cols(df: DataFrame) -> DataFrame:
    return plain_time(df.select("event_id", "ts", "severity", "message"), "ts")


@query(f"SELECT {_COLS} FROM l WHERE {_RANGE}")
def filter_time_range(spark, sf):
    return _cols(filters.time_range(log_lines(spark, sf), SINCE, UNTIL))


@query(f"SELECT {_COLS} FROM l WHERE severity_rank >= 3")
def filter_min_severity(spark, sf):
    return _cols(filters.min_severity(log_lines(spark, sf), "WARN"))


@query(f"SELECT {_COLS} FROM l WHERE {_RANGE} AND severity_rank >= 3")
def filter_combined(spark, sf):
    return _cols(filters.match(log_lines(spark, sf), SINCE, UNTIL, "WARN"))


@query("SELECT event_id, raw FROM l WHERE date_trunc('second', ts) >= TIMESTAMP '2024-01-10' AND date_trunc('second', ts) <= TIMESTAMP '2024-01-12' AND severity_rank >= 3")
def slice_basic(spark, sf):
    return slice_lines(log_lines(spark, sf).select("event_id", "raw"), SINCE, UNTIL, "WARN").select("event_id", "raw")


@query("SELECT event_id, raw FROM l WHERE regexp_matches(raw, 'type=(error|signup)')")
def grep_match(spark, sf):
    return filters.grep(log_lines(spark, sf), "type=(error|signup)").select("event_id", "raw")


@query("SELECT event_id, raw FROM l WHERE NOT regexp_matches(raw, 'type=(error|signup)')")
def grep_invert(spark, sf):
    return filters.grep(log_lines(spark, sf), "type=(error|signup)", invert=True).select("event_id", "raw")


# --- order-dependent operators ------------------------------------------------------------------------------------


@query(f"SELECT event_id, raw FROM (SELECT *, row_number() OVER ({_O}) AS n FROM l) WHERE n % 10 = 0")
def sample_every_n(spark, sf):
    return events.sample_every(log_lines(spark, sf), 10, KEYS).select("event_id", "raw")


_RUNS = f"""WITH a AS (SELECT event_id, ts, event_type, lag(event_type) OVER ({_O}) AS was FROM l),
  b AS (SELECT *, sum(CASE WHEN was IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END) OVER ({_O} ROWS UNBOUNDED PRECEDING) AS run FROM a),
  c AS (SELECT run, arg_min(event_id, (ts, event_id)) AS event_id, any_value(event_type) AS event_type, count(*) - 1 AS more FROM b GROUP BY run) """


@query(_RUNS + """SELECT event_id, event_type AS message, 0::BIGINT AS repeats FROM c UNION ALL
  SELECT event_id, event_type || ' [repeated ' || more || ' time(s)]', more FROM c WHERE more > 0""")
def dedupe_consecutive(spark, sf):
    rows = log_lines(spark, sf).select("event_id", "ts", F.col("event_type").alias("message"))
    return events.dedupe_runs(rows, KEYS).select("event_id", "message", "repeats")


@query(f"SELECT event_id FROM (SELECT *, lag(ts) OVER (PARTITION BY event_type {_O}) AS was FROM l) WHERE was IS NULL OR ts - was > INTERVAL 10 MINUTE")
def dedupe_windowed(spark, sf):
    return events.dedupe_within(log_lines(spark, sf).withColumn("message", F.col("event_type")), 600, KEYS).select("event_id")


@query(f"SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY date_trunc('second', ts) {_O}) AS n FROM l) WHERE n <= 1")
def rate_limit(spark, sf):
    return events.rate_limit(log_lines(spark, sf), 1, KEYS).select("event_id")


@query(f"SELECT event_id, CAST((row_number() OVER ({_O}) - 1) // 100 AS BIGINT) AS emit_second FROM l")
def throttle_schedule(spark, sf):
    return events.throttle(log_lines(spark, sf), 100, KEYS).select("event_id", "emit_second")


@query("SELECT event_id, ts FROM l WHERE ts >= (SELECT max(ts) FROM l) - INTERVAL 24 HOUR")
def retention_window(spark, sf):
    return plain_time(events.retain(log_lines(spark, sf), 86400, KEYS).select("event_id", "ts"), "ts")


@query(f"SELECT event_id, CAST(row_number() OVER ({_O}) AS VARCHAR) AS seq FROM l")
def enrich_sequence(spark, sf):
    return events.sequence(log_lines(spark, sf), KEYS).select("event_id", "seq")


@query(f"""WITH g AS (SELECT *, greatest(coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER ({_O})), 0), 0) AS gap FROM l)
  SELECT event_id, CAST(floor(CAST(sum(gap) OVER ({_O} ROWS UNBOUNDED PRECEDING) AS BIGINT) / 10.0::DOUBLE) AS BIGINT) AS emit_us FROM g""")
def replay_schedule(spark, sf):
    return events.replay(log_lines(spark, sf), 10.0, KEYS).select("event_id", "emit_us")


def _alert_sql(severity: str, threshold: int, hours: int, seconds: float, said: str) -> str:
    return f"""SELECT event_id, ts AS fired_at, severity, count, {threshold}::BIGINT AS threshold, {seconds}::DOUBLE AS window_seconds,
      'alert: {severity} count ' || count || ' >= threshold {threshold} in last {said}' AS alert
      FROM (SELECT *, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL {hours} HOUR PRECEDING AND CURRENT ROW) AS count FROM l WHERE severity = '{severity}')
      WHERE count >= {threshold}"""


_FATAL, _WARN = detect.Rule("FATAL", 3, timedelta(hours=6)), detect.Rule("WARN", 5, timedelta(hours=1))
_ALERT_COLS = ("event_id", "fired_at", "severity", "count", "threshold", "window_seconds", "alert")


@query(_alert_sql("FATAL", 3, 6, 21600.0, "6h0m0s"))
def alert_threshold(spark, sf):
    return plain_time(detect.alerts(log_lines(spark, sf), [_FATAL], KEYS, peers=True).select(*_ALERT_COLS), "fired_at")


@query(f"SELECT *, 'pager' AS target FROM ({_alert_sql('FATAL', 3, 6, 21600.0, '6h0m0s')}) UNION ALL SELECT *, 'mail' AS target FROM ({_alert_sql('WARN', 5, 1, 3600.0, '1h0m0s')})")
def alert_multi(spark, sf):
    found = detect.multi_alerts(log_lines(spark, sf), {"pager": [_FATAL], "mail": [_WARN]}, KEYS, peers=True)
    return plain_time(found.select(*_ALERT_COLS, "target"), "fired_at")


_BURST = "count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)"


@query(f"SELECT event_id, {_BURST} AS in_window, {_BURST} / 3600.0::DOUBLE AS rate FROM l")
def burst_rate(spark, sf):
    return detect.burst_rate(log_lines(spark, sf), timedelta(hours=1), KEYS, peers=True).select("event_id", "in_window", "rate")


@query(f"""WITH r AS (SELECT event_id, ts, {_BURST} AS n FROM l), w AS (SELECT *, coalesce(lag(n) OVER ({_O}), 0) AS was FROM r)
  SELECT event_id, ts FROM w WHERE n >= 24 AND was < 24""")
def burst_detect(spark, sf):
    return plain_time(detect.bursts(log_lines(spark, sf), 24 / 3600, timedelta(hours=1), KEYS, peers=True).select("event_id", "ts"), "ts")


# --- text and fields ----------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, regexp_replace(text, '(token = ")[0-9a-f]+(")', '\1[REDACTED]\2', 'g') AS text FROM documents""", raw_sql=True)
def mask_groups(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.mask(F.col("text"), [TOKEN]).alias("text"))


_REDACT = r"""SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}', '{0}', 'g'), 'token = "([0-9a-f]+)"', '{0}', 'g') AS text FROM documents"""


@query(_REDACT.format("[REDACTED]"), raw_sql=True)
def redact_patterns(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.redact(F.col("text"), [EMAIL, TOKEN]).alias("text"))


@query(_REDACT.format("***"), raw_sql=True)
def redact_custom_placeholder(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.redact(F.col("text"), [EMAIL, TOKEN], "***").alias("text"))


# DuckDB can't cut text by bytes: the longest run of characters whose UTF-8 length fits is found by counting.
@query("""SELECT doc_id, CASE WHEN strlen(text) <= 80 THEN text ELSE
    text[1 : len([n FOR n IN range(1, 78) IF n <= length(text) AND strlen(text[1 : CAST(n AS INT)]) <= 77])] || '...' END AS text FROM documents""", raw_sql=True)
def truncate_bytes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.truncate(F.col("text"), 80, "...").alias("text"))


@query("SELECT event_id, CASE split_part(kv, '=', 1) WHEN 'user' THEN 'user_id' WHEN 'type' THEN 'kind' ELSE split_part(kv, '=', 1) END AS key, "
       "CASE split_part(kv, '=', 1) WHEN 'type' THEN upper(split_part(kv, '=', 2)) ELSE split_part(kv, '=', 2) END AS value "
       "FROM (SELECT event_id, unnest(string_split(message, ' ')) AS kv FROM l)")
def normalize_fields(spark, sf):
    rules = [maps.Rename("user", "user_id"), maps.Rename("TYPE", "kind", F.upper)]
    return log_lines(spark, sf).select("event_id", F.explode(maps.normalize(maps.extract_kv(F.col("message")), rules)))


@query("SELECT event_id, 'prod' AS env, 'eu' AS region, CAST(user_id AS VARCHAR) AS user FROM l")
def enrich_static(spark, sf):
    fields = maps.enrich(maps.extract_kv(F.col("message"), "user"), maps.static({"env": "test", "region": "eu"}), maps.static({"env": "prod"}))
    return log_lines(spark, sf).select("event_id", *[fields[k].alias(k) for k in ("env", "region", "user")])


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_ENV = "HOME" if "HOME" in os.environ else "PATH"


@query(f"SELECT event_id, {_text(socket.gethostname())} AS host FROM l")
def enrich_host(spark, sf):
    return log_lines(spark, sf).select("event_id", maps.enrich(F.lit(None).cast("map<string,string>"), maps.host())["host"].alias("host"))


@query(f"SELECT event_id, {_text(os.environ.get(_ENV, ''))} AS home FROM l")
def enrich_env(spark, sf):
    return log_lines(spark, sf).select("event_id", maps.enrich(F.lit(None).cast("map<string,string>"), maps.env([_ENV], {_ENV: "home"}))["home"].alias("home"))


_COLOUR = "CASE WHEN severity_rank >= 4 THEN '[31m' WHEN severity_rank = 3 THEN '[33m' WHEN severity_rank = 2 THEN '[36m' ELSE '[37m' END"


@query(f"SELECT event_id, chr(27) || {_COLOUR} || raw || chr(27) || '[0m' AS line FROM l")
def highlight_line(spark, sf):
    return log_lines(spark, sf).select("event_id", text.highlight_line(F.col("raw"), F.col("severity")).alias("line"))


@query(f"SELECT event_id, chr(27) || '[1m' || chr(27) || {_COLOUR} || severity || chr(27) || '[0m' AS label FROM l")
def highlight_severity(spark, sf):
    return log_lines(spark, sf).select("event_id", text.highlight_severity(F.col("severity")).alias("label"))


@query("SELECT event_id, raw AS value FROM l")
def format_raw(spark, sf):
    return log_lines(spark, sf).select("event_id", F.col("raw").alias("value"))


@query("""SELECT event_id, '{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","severity":"' || severity || '","message":"' || message || '"}' AS value FROM l""")
def format_json(spark, sf):
    return log_lines(spark, sf).select("event_id", text.to_json(F.col("ts"), F.col("severity"), F.col("message")).alias("value"))


# --- aggregation --------------------------------------------------------------------------------------------------


def _bucket_sql(width: str) -> str:
    return f"""SELECT time_bucket(INTERVAL {width}, ts, TIMESTAMP '0001-01-01') AS start, 0::BIGINT AS unknown, count(*) FILTER (severity = 'DEBUG') AS debug,
      count(*) FILTER (severity = 'INFO') AS info, count(*) FILTER (severity = 'WARN') AS warn, count(*) FILTER (severity = 'ERROR') AS error,
      count(*) FILTER (severity = 'FATAL') AS fatal, count(*) AS total FROM l GROUP BY 1"""


@query(_bucket_sql("1 HOUR"))
def bucket_counts(spark, sf):
    return plain_time(aggregate.bucket_counts(log_lines(spark, sf), timedelta(hours=1)), "start")


@query(_bucket_sql("7 DAY"))
def bucket_counts_weekly(spark, sf):
    return plain_time(aggregate.bucket_counts(log_lines(spark, sf), timedelta(days=7)), "start")


@query("SELECT count(DISTINCT date_trunc('hour', ts)) AS buckets FROM l")
def bucket_cardinality(spark, sf):
    return aggregate.bucket_cardinality(log_lines(spark, sf), timedelta(hours=1))


@query("SELECT severity, count(*) AS n FROM l GROUP BY severity")
def level_counts(spark, sf):
    return aggregate.level_counts(log_lines(spark, sf))


@query("SELECT count(*) AS total FROM l")
def level_total(spark, sf):
    return aggregate.level_total(log_lines(spark, sf))


@query("SELECT count(*) AS lines_read, count(*) FILTER (severity_rank >= 3) AS lines_matched, CAST(sum(strlen(raw)) AS BIGINT) AS bytes_read FROM l")
def run_stats(spark, sf):
    return aggregate.run_stats(log_lines(spark, sf), F.col("severity_rank") >= 3)


@query("SELECT DISTINCT event_type AS bucket FROM l WHERE event_type <> ''")
def split_keys(spark, sf):
    return aggregate.split_keys(log_lines(spark, sf), F.col("event_type"))


@query("SELECT event_id, raw FROM l WHERE event_type = 'purchase'")
def split_bucket(spark, sf):
    return aggregate.split_bucket(log_lines(spark, sf), F.col("event_type"), "purchase").select("event_id", "raw")


# --- merging and positions ----------------------------------------------------------------------------------------


@query("""SELECT source_idx, key, line, ts, row_number() OVER (ORDER BY ts, source_idx, key, line) AS merge_rank FROM (
    SELECT 0::INT AS source_idx, o_orderkey AS key, 0::INT AS line, o_orderdate AS ts FROM orders UNION ALL
    SELECT 1::INT, l_orderkey, l_linenumber, l_shipdate FROM lineitem)""", raw_sql=True)
def merge_sorted(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.lit(0).alias("line"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").cast("timestamp").alias("ts"))
    both = combine.tagged([a, None, b]).withColumn("source_idx", F.least("source_idx", F.lit(1)))  # the missing source has a place too
    rows = combine.merge_rank(both, ("ts", "source_idx", "key", "line"))
    return plain_time(rows.select("source_idx", "key", "line", "ts", "merge_rank"), "ts")


@query("SELECT event_id, CAST(user_id % 4 AS INT) AS source_idx, row_number() OVER (ORDER BY ts, user_id % 4, event_id) AS merge_rank FROM l")
def multifile_merge(spark, sf):
    rows = log_lines(spark, sf).withColumns({"source_idx": (F.col("user_id") % 4).cast("int"), "line_no": F.col("event_id")})
    return combine.merge_rank(combine.good_lines(rows), ("ts", "source_idx", "event_id")).select("event_id", "source_idx", "merge_rank")


@query(f"WITH {_OFFSETS} SELECT byte_offset, raw FROM o ORDER BY byte_offset DESC LIMIT 50")
def tail_n(spark, sf):
    """The end of the log file is read, nothing else."""
    return parse.parse_lines(spots.tail(spark, log_file(spark, sf), 50)).select("byte_offset", "raw")


@query("SELECT event_id, raw FROM l WHERE severity_rank >= 4 ORDER BY ts DESC, event_id DESC LIMIT 50")
def tail_matching(spark, sf):
    return positions.tail_matching(filters.min_severity(log_lines(spark, sf), "ERROR"), 50, KEYS).select("event_id", "raw")


def _with_offsets(spark: SparkSession, sf: str) -> DataFrame:
    rows = log_lines(spark, sf)
    s = Stream(rows, KEYS).running_sums({"_n": F.lit(1), "_end": F.octet_length("raw") + 1})
    return s.df.withColumns({"line_no": F.col("_n") - 1, "byte_offset": F.col("_end") - F.octet_length("raw") - 1}).drop("_n", "_end")


@query(f"WITH {_OFFSETS} SELECT byte_offset, raw FROM o WHERE byte_offset < 500000 ORDER BY byte_offset DESC LIMIT 50")
def rewind_n(spark, sf):
    """Some chunks before the place are read, nothing else."""
    return parse.parse_lines(spots.rewind(spark, log_file(spark, sf), 500_000, 50)).select("byte_offset", "raw")


@query(f"WITH {_OFFSETS} SELECT byte_offset, raw FROM o WHERE byte_offset >= (SELECT byte_offset FROM o WHERE line_no = (SELECT count(*) * 3 // 4 FROM l))")
def scan_from_offset(spark, sf):
    """Reading begins at the offset of a line three quarters down the file."""
    path = log_file(spark, sf)
    down = log_lines(spark, sf).count() * 3 // 4
    start = lines.read_lines(spark, path).filter(F.col("line_no") == down).first()["byte_offset"]
    return spots.lines_of(spark, path, start).select("byte_offset", "raw")


_NOON = datetime(2024, 1, 15, 12, tzinfo=timezone.utc)
# The time of day of a line in a file has no fraction of a second.
_AT_NOON = "date_trunc('second', ts) >= TIMESTAMP '2024-01-15 12:00:00'"


@query(f"WITH {_OFFSETS} SELECT min(byte_offset) AS byte_offset FROM o WHERE {_AT_NOON}")
def seek_to_time(spark, sf):
    """A search that looks at a few places of the file."""
    return spark.createDataFrame([(spots.seek(spark, log_file(spark, sf), _NOON),)], "byte_offset long")


@query(f"WITH {_OFFSETS} SELECT byte_offset, raw FROM o WHERE {_AT_NOON}")
def indexed_since(spark, sf):
    """A sparse index of the file, its floor at a time, and the lines from there on."""
    return IndexedLog(spark, log_file(spark, sf)).since(_NOON).select("byte_offset", "raw")


_INDEX = f"""{_OFFSETS}, p AS (SELECT line_no, ts, byte_offset, max(ts) OVER (ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM o WHERE line_no % 500 = 0),
  i AS (SELECT line_no, ts, byte_offset FROM p WHERE top IS NULL OR ts > top OR line_no = 0)"""


@query(f"WITH {_INDEX} SELECT line_no, ts, byte_offset FROM i")
def time_index_build(spark, sf):
    return plain_time(positions.build_index(_with_offsets(spark, sf), 500, KEYS).select("line_no", "ts", "byte_offset"), "ts")


@query(f"""WITH {_INDEX}, t AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-31', TIMESTAMP '2024-01-31', INTERVAL 6 HOUR)) AS target)
  SELECT target, (SELECT max(byte_offset) FROM i WHERE i.ts <= t.target) AS byte_offset FROM t""")
def time_index_floor(spark, sf):
    every = F.sequence(F.lit(datetime(2023, 12, 31, tzinfo=timezone.utc)), F.lit(datetime(2024, 1, 31, tzinfo=timezone.utc)), F.expr("interval 6 hours"))
    targets = spark.range(1).select(F.explode(every).alias("target"))
    index = positions.build_index(_with_offsets(spark, sf), 500, KEYS)
    return plain_time(positions.floor_offset(index, targets), "target")


# --- stores, streams and sinks over the log file ------------------------------------------------------------------

_FILE_INDEX = _INDEX.replace("SELECT line_no, ts, byte_offset, max(ts)", "SELECT line_no, date_trunc('second', ts) AS ts, byte_offset, max(date_trunc('second', ts))")


@query(f"WITH {_FILE_INDEX} SELECT line_no, ts, byte_offset, true AS cached FROM i")
def index_cache(spark, sf):
    """The index from the cache, when it is asked for again."""
    log = IndexedLog(spark, log_file(spark, sf))
    cached = log.index() is log.index()
    return plain_time(log.index().select("line_no", "ts", "byte_offset", F.lit(cached).alias("cached")), "ts")


_PARSED = "byte_offset, date_trunc('second', ts) AS ts, severity, message"


@query(f"WITH {_OFFSETS} SELECT {_PARSED} FROM o")
def follow_stream(spark, sf):
    """The file as a stream that is followed from its begin until all there is has come."""
    folder = scratch(spark)
    stream = follow.follow(spark, log_file(spark, sf), start="begin").select("byte_offset", "ts", "severity", "message")
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(once=True).start().awaitTermination()
    return plain_time(spark.read.parquet(f"{folder}/out"), "ts")


@query("SELECT * FROM (VALUES (0, 'same', false), (1, 'longer', false), (2, 'cut', true), (3, 'same', false), (4, 'replaced', true)) AS t(step, change, rotated)", raw_sql=True)
def rotation_detect(spark, sf):
    """What the watch says after each change to a copy of the file."""
    path = shutil.copyfile(log_file(spark, sf), f"{scratch(spark)}/copy.log")
    watch, out = logfile.Watch(path), []

    def longer():
        with open(path, "ab") as f:
            f.write(b"one line more\n")

    def replaced():
        os.replace(shutil.copyfile(log_file(spark, sf), path + ".new"), path)

    changes = [("same", lambda: None), ("longer", longer), ("cut", lambda: os.truncate(path, 10)), ("same", lambda: None), ("replaced", replaced)]
    for i, (name, change) in enumerate(changes):
        change()
        out.append((i, name, watch.rotated()))
    return spark.createDataFrame(out, "step int, change string, rotated boolean")


_HALF = "(SELECT byte_offset FROM o WHERE line_no = (SELECT count(*) // 2 FROM l))"


@query(f"WITH {_OFFSETS} SELECT byte_offset, raw, CASE WHEN byte_offset < {_HALF} THEN 1 ELSE 2 END AS run FROM o")
def checkpoint_resume(spark, sf):
    """Half of the file is there at the first run, all of it at the second, which goes on where the first one stopped."""
    folder, path = scratch(spark), log_file(spark, sf)
    half = lines.read_lines(spark, path).filter(F.col("line_no") == log_lines(spark, sf).count() // 2).first()["byte_offset"]
    copy, store, out = f"{folder}/growing.log", stores.CheckpointStore(f"{folder}/checkpoints"), None
    for run, size in ((1, half), (2, os.path.getsize(path))):
        with open(path, "rb") as whole, open(copy, "ab") as f:
            whole.seek(f.tell())
            f.write(whole.read(size - f.tell()))
        was = store.load(copy)
        begin = was.offset if was else 0
        rows = spots.lines_of(spark, copy, begin, size).select("byte_offset", "raw", F.lit(run).alias("run"))
        out = rows if out is None else out.unionByName(rows)
        store.save(stores.Checkpoint(copy, size))
    return out


@query("SELECT severity AS key, CAST(sum(strlen(raw) + 1) AS BIGINT) AS offset, CAST(sum(strlen(raw) + 1) AS BIGINT) AS file_size FROM l GROUP BY severity")
def offset_store(spark, sf):
    """How far each severity's own file was read, from the store, opened anew."""
    path = f"{scratch(spark)}/offsets.json"
    per = log_lines(spark, sf).groupBy("severity").agg(F.sum(F.octet_length("raw") + 1).alias("n")).collect()  # a row a severity
    store = stores.OffsetStore(path)
    for r in per:
        store.put(r["severity"], r["n"], r["n"])
    again = stores.OffsetStore(path)
    return spark.createDataFrame([(r["severity"], *again.get(r["severity"])) for r in per], "key string, offset long, file_size long")


@query("""SELECT 'raw' AS sink, raw AS value, 1::BIGINT AS failed FROM l WHERE severity_rank >= 4 UNION ALL
  SELECT 'json', '{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","severity":"' || severity || '","message":"' || message || '"}', 1 FROM l WHERE severity_rank >= 4""")
def fanout_sinks(spark, sf):
    """Text and JSON sinks beside one that fails: what the others have written, and how many failed."""
    folder = f"file://{scratch(spark)}"

    def broken(_):
        raise OSError("no space left")

    fan = combine.Fanout(lambda df: sinks.write_text(df, f"{folder}/raw"), broken, lambda df: sinks.write_text(df, f"{folder}/json", "json"))
    failed = fan.send(filters.min_severity(log_lines(spark, sf), "ERROR"))
    both = spark.read.text(f"{folder}/raw").withColumn("sink", F.lit("raw")).unionByName(spark.read.text(f"{folder}/json").withColumn("sink", F.lit("json")))
    return both.select("sink", "value", F.lit(len(failed)).cast("long").alias("failed"))


@query(f"SELECT row_number() OVER (ORDER BY start) AS place, start, total FROM ({_bucket_sql('1 HOUR')})")
def buckets_in_order(spark, sf):
    """Hourly counts as a sink has written them, with their place in its files."""
    folder = f"file://{scratch(spark)}"
    sinks.write_counts(aggregate.bucket_counts(log_lines(spark, sf), timedelta(hours=1)), f"{folder}/counts")
    # the sink's files have one line a bucket and follow each other by name
    rows = lines.read_lines(spark, f"{folder}/counts")
    rows = Stream(rows, ("source_idx", "line_no")).position("place").df
    fields = F.from_json("raw", "start timestamp, total long")
    return plain_time(rows.select("place", fields["start"].alias("start"), fields["total"].alias("total")), "start")


@query("SELECT event_type AS bucket, raw AS value FROM l WHERE event_type <> ''")
def bucket_writer(spark, sf):
    folder = f"file://{scratch(spark)}"
    sinks.write_buckets(log_lines(spark, sf), f"{folder}/buckets", F.col("event_type"))
    return spark.read.text(f"{folder}/buckets").select("bucket", "value")


@query(f"SELECT alert AS value FROM ({_alert_sql('FATAL', 3, 6, 21600.0, '6h0m0s')})")
def alert_writer(spark, sf):
    folder = f"file://{scratch(spark)}"
    sinks.write_alerts(detect.alerts(log_lines(spark, sf), [_FATAL], KEYS, peers=True), f"{folder}/alerts")
    return spark.read.text(f"{folder}/alerts")


@query("SELECT 'lines read: ' || count(*) || ', matched: ' || count(*) FILTER (severity_rank >= 3) || ', bytes read: ' || CAST(sum(strlen(raw)) AS BIGINT) || ', elapsed: 1.500s' AS line FROM l")
def stats_line(spark, sf):
    found = aggregate.run_stats(log_lines(spark, sf), F.col("severity_rank") >= 3).first().asDict()
    return spark.createDataFrame([(aggregate.stats_text(found, 1.5),)], "line string")


@query("SELECT * FROM (VALUES ('', 'raw'), ('raw', 'raw'), ('Raw', 'raw'), ('RAW', 'raw'), ('json', 'json'), ('Json', 'json'), ('JSON', 'json'), ('jSON', 'unknown'), ('xml', 'unknown')) AS t(name, kind)", raw_sql=True)
def format_name(spark, sf):
    def kind(name):
        try:
            return text.parse_format(name)
        except ValueError:
            return "unknown"

    return spark.createDataFrame([(n, kind(n)) for n in ("", "raw", "Raw", "RAW", "json", "Json", "JSON", "jSON", "xml")], "name string, kind string")


@query(f"WITH {_OFFSETS} SELECT line_no, raw FROM o")
def scan_stdin(spark, sf):
    with open(log_file(spark, sf), encoding="utf-8", newline="\n") as f:
        return lines.from_stdin(spark, f).select("line_no", "raw")


@query(f"WITH {_OFFSETS} SELECT row_number() OVER (ORDER BY line_no) AS place, raw AS line FROM o WHERE date_trunc('second', ts) >= TIMESTAMP '2024-01-10' AND date_trunc('second', ts) <= TIMESTAMP '2024-01-12' AND severity_rank >= 3")
def cli_slice(spark, sf):
    """What the command line writes for a time range and a severity."""
    out = io.StringIO()
    cli.run(["--since", "2024-01-10 00:00:00", "--until", "2024-01-12 00:00:00", "--severity", "WARN", log_file(spark, sf)], out=out, spark=spark)
    return spark.createDataFrame(list(enumerate(out.getvalue().splitlines(), 1)), "place long, line string")


def _streamed(spark: SparkSession, sf: str, fold: folds.Fold) -> DataFrame:
    """What a fold gives on the log file as a stream (the message being the event's type), with a last line that marks its end."""
    folder = scratch(spark)
    path = shutil.copyfile(log_file(spark, sf), f"{folder}/ended.log")
    with open(path, "a") as f:
        f.write("2030-01-01T00:00:00Z INFO end of the log\n")
    kind = F.regexp_extract("message", r"type=(\w+)", 1)
    stream = follow.follow(spark, path, start="begin").withColumn("source", F.lit("log")).withColumn("whole", F.col("message")).withColumn("message", kind)
    out = run_fold(stream, fold, end=F.col("whole") == "end of the log")
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(once=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query(f"""WITH {_OFFSETS}, a AS (SELECT line_no, byte_offset, event_type, lag(event_type) OVER (ORDER BY line_no) AS was FROM o),
  b AS (SELECT *, sum(CASE WHEN was IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END) OVER (ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS run FROM a),
  c AS (SELECT run, min(byte_offset) AS byte_offset, any_value(event_type) AS message, count(*) - 1 AS more FROM b GROUP BY run)
  SELECT byte_offset, message FROM c UNION ALL SELECT byte_offset, message || ' [repeated ' || more || ' time(s)]' FROM c WHERE more > 0""")
def stream_dedupe(spark, sf):
    return _streamed(spark, sf, folds.dedupe_runs()).select(F.col("line_no").alias("byte_offset"), "message")


@query(f"""WITH {_OFFSETS}, t AS (SELECT *, date_trunc('second', ts) AS s FROM o WHERE severity = 'FATAL'),
  n AS (SELECT byte_offset, count(*) OVER (ORDER BY s RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS near, count(*) OVER (PARTITION BY s) - row_number() OVER (PARTITION BY s ORDER BY byte_offset) AS after FROM t)
  SELECT byte_offset, near - after AS count FROM n WHERE near - after >= 3""")
def stream_alerts(spark, sf):
    return _streamed(spark, sf, folds.threshold_alert("FATAL", 3, 6 * 3_600_000_000)).select(F.col("line_no").alias("byte_offset"), "count")


@query("SELECT date_trunc('hour', ts) AS start, severity, count(*) AS n FROM l GROUP BY 1, 2")
def stream_buckets(spark, sf):
    """Tumbling windows of a stream."""
    name = f"buckets_{os.path.basename(scratch(spark)).replace('-', '_')}"
    counts = stateful.bucket_counts(follow.follow(spark, log_file(spark, sf), start="begin"), "1 hour")
    counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", scratch(spark)).trigger(once=True).start().awaitTermination()
    return plain_time(spark.table(name), "start")


# --- the whole pipeline -------------------------------------------------------------------------------------------

_CUT = "CASE WHEN strlen(raw) <= 60 THEN raw ELSE substr(raw, 1, 57) || '...' END"


@query(f"""WITH f AS (SELECT * FROM l WHERE {_RANGE} AND severity_rank >= 2),
  a AS (SELECT *, lag(event_type) OVER ({_O}) AS was FROM f),
  b AS (SELECT *, sum(CASE WHEN was IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END) OVER ({_O} ROWS UNBOUNDED PRECEDING) AS run FROM a),
  r AS (SELECT run, arg_min((event_id, ts, raw), (ts, event_id)) AS h, any_value(event_type) AS event_type, count(*) - 1 AS more FROM b GROUP BY run),
  d AS (SELECT h[1] AS event_id, h[2] AS ts, h[3] AS raw, event_type AS message, 0 AS k FROM r UNION ALL
        SELECT h[1], h[2], h[3], event_type || ' [repeated ' || more || ' time(s)]', 1 FROM r WHERE more > 0),
  s AS (SELECT *, row_number() OVER (ORDER BY ts, event_id, message) AS n FROM d),
  t AS (SELECT *, row_number() OVER (PARTITION BY date_trunc('second', ts) ORDER BY ts, event_id, message) AS m FROM s WHERE n % 3 = 0)
  SELECT event_id, ts, message, {_CUT} AS raw FROM t WHERE m <= 1""")
def pipeline_full(spark, sf):
    config = Config(since=SINCE, until=UNTIL, min_severity="INFO", dedupe=True, sample_rate=3, rate_limit=1, max_line_len=60)
    rows = log_lines(spark, sf).withColumn("message", F.col("event_type"))
    return plain_time(process(rows, config, ("ts", "event_id", "message"), ()).select("event_id", "ts", "message", "raw"), "ts")

