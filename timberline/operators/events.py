"""Order-dependent operators: sampling, duplicate suppression, rates, retention, multi-line events, sequences, replay.

``keys`` give the order of a stream, and ``by`` the columns that tell streams apart (none: all rows are one stream).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.operators.ordered import Ranges, Stream

ORDER = ("line_no",)


def _with_stream_row(df: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    """df with the columns of ``small``, which has one row a stream; null keys are equal."""
    if not by:
        return df.withColumns({c: F.lit(v) for c, v in small.first().asDict(recursive=False).items()})
    renamed = small.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], *[c for c in small.columns if c not in by])
    on = F.lit(True)
    for i, b in enumerate(by):
        on &= F.col(b).eqNullSafe(F.col(f"_k{i}"))
    return df.join(renamed, on).drop(*[f"_k{i}" for i in range(len(by))])


def sample_every(df: DataFrame, n: int, keys: Sequence[str] = ORDER, by: Sequence[str] = (), ranges: Ranges | None = None) -> DataFrame:
    """Rows n, 2n, 3n, ... of each stream; n < 1 counts as 1. ranges: of the first key, if they are known already."""
    if n <= 1:
        return df
    return Stream(df, keys, by, ranges).position("_n").df.filter(F.col("_n") % n == 0).drop("_n")


def dedupe_runs(
    df: DataFrame, keys: Sequence[str] = ORDER, by: Sequence[str] = (), message: str = "message", repeats: str = "repeats", ranges: Ranges | None = None,
) -> DataFrame:
    """Of each run of equal messages the first row, then, if c more followed, a copy with " [repeated c time(s)]".

    Column ``repeats`` is 0 for the first row and c for the copy. Null messages equal each other.
    """
    s = Stream(df, keys, by, ranges).position_and_last(F.struct(F.col(message)), "_n", "_was", "_total")
    new = F.col("_was").isNull() | ~F.col("_was")[message].eqNullSafe(F.col(message))
    # a run's length is the distance to the next run's head, or to the stream's end
    heads = s._with(s._df.filter(new).drop("_was")).next_of_ranges(F.col("_n"), "_later")
    rows = heads._df.withColumn("_next", F.coalesce(F.lead("_n").over(heads.whole().orderBy("_n")), F.col("_later"), F.col("_total") + 1))
    rows = rows.withColumn("_c", F.col("_next") - F.col("_n") - 1)
    kinds = F.when(F.col("_c") > 0, F.array(F.lit(0).cast("long"), F.col("_c"))).otherwise(F.array(F.lit(0).cast("long")))
    rows = rows.drop("_n", "_next", "_later", "_total", "_range").withColumn(repeats, F.explode(kinds)).drop("_c")
    text = F.concat(F.coalesce(message, F.lit("")), F.lit(" [repeated "), F.col(repeats).cast("string"), F.lit(" time(s)]"))
    return rows.withColumn(message, F.when(F.col(repeats) > 0, text).otherwise(F.col(message)))


def dedupe_within(df: DataFrame, seconds: float, keys: Sequence[str] = ("ts", "line_no"), by: Sequence[str] = (), message: str = "message") -> DataFrame:
    """Rows whose message didn't occur in the ``seconds`` before (at most that old); rows are ordered by time first."""
    s = Stream(df, keys, [*by, message]).last_before(F.col(keys[0]), "_was")
    gap = F.unix_micros(F.col(keys[0]).cast("timestamp")) - F.unix_micros(F.col("_was").cast("timestamp"))
    return s.df.filter(F.col("_was").isNull() | (gap > round(seconds * 1_000_000))).drop("_was")


def rate_limit(df: DataFrame, rate: int, keys: Sequence[str] = ("ts", "line_no"), by: Sequence[str] = ()) -> DataFrame:
    """The first ``rate`` rows of each second of event time; 0 lets all pass; negative rates raise."""
    if rate < 0:
        raise ValueError("a rate can't be negative")
    if rate == 0:
        return df
    second = Window.partitionBy(*by, F.date_trunc("second", F.col(keys[0]))).orderBy(*keys)
    return df.withColumn("_n", F.row_number().over(second)).filter(F.col("_n") <= rate).drop("_n")


def throttle(df: DataFrame, rate: int, keys: Sequence[str] = ORDER, by: Sequence[str] = (), out: str = "emit_second") -> DataFrame:
    """All rows, with the second (from 0) in which each may go if all arrive at once; rate <= 0: all in the first."""
    if rate <= 0:
        return df.withColumn(out, F.lit(0).cast("long"))
    return Stream(df, keys, by).position("_n").df.withColumn(out, F.floor((F.col("_n") - 1) / rate).cast("long")).drop("_n")


def retain(df: DataFrame, seconds: float, keys: Sequence[str] = ("ts", "line_no"), by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """What a retention window of that length holds after the last row: all but the stale rows before the first fresh one.

    Fresh: not older than ``seconds`` before the stream's last row. seconds <= 0 keeps all.
    """
    if seconds <= 0:
        return df
    at, width = F.unix_micros(F.col(ts).cast("timestamp")), round(seconds * 1_000_000)
    s = Stream(df, keys, by)
    if s.one:
        rows = s._df.withColumns({"_n": F.row_number().over(s.inside()), "_now": F.last(at).over(s.inside().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
        first = F.min(F.when(at >= F.col("_now") - width, F.col("_n"))).over(s.whole())
        return rows.withColumn("_first", first).filter("_n >= _first").drop("_now", "_first", "_n", "_range")
    rows = s.position("_n").df
    last = rows.groupBy(*by).agg(F.max_by(at, F.col("_n")).alias("_now"))
    rows = _with_stream_row(rows, last, by)
    first = rows.groupBy(*by).agg(F.min(F.when(at >= F.col("_now") - width, F.col("_n"))).alias("_first"))
    return _with_stream_row(rows, first, by).filter("_n >= _first").drop("_now", "_first", "_n")


def coalesce_events(df: DataFrame, max_lines: int = 0, keys: Sequence[str] = ORDER, by: Sequence[str] = ("source",), ts: str = "ts", message: str = "message") -> DataFrame:
    """Rows with a null ts go on with the row before: their messages are joined to its by newlines.

    At most max_lines lines an event (0: all), the rest is dropped. A row with a null ts that begins a stream is an event
    of its own. Other columns are those of the event's first row.
    """
    s = Stream(df, keys, by).running_sum(F.col(ts).isNotNull().cast("int"), "_event")
    rows = s.df
    if max_lines > 0:  # what is dropped is dropped before lines are gathered
        rows = rows.withColumn("_line", F.row_number().over(Window.partitionBy(*by, "_event").orderBy(*keys))).filter(F.col("_line") <= max_lines).drop("_line")
    body = F.struct(*keys, F.col(message).alias("_m"))
    rest = [c for c in df.columns if c not in (*by, message)]
    events = rows.groupBy(*by, "_event").agg(F.sort_array(F.collect_list(body)).alias("_lines"), F.min_by(F.struct(*rest), F.struct(*keys)).alias("_head"))
    lines = F.col("_lines")
    text = F.array_join(F.transform(lines, lambda x: F.coalesce(x["_m"], F.lit(""))), "\n")
    return events.select(*[F.col(b) for b in by], *[F.col("_head")[c].alias(c) for c in rest], text.alias(message)).select(*df.columns)


def sequence(df: DataFrame, keys: Sequence[str] = ORDER, by: Sequence[str] = (), out: str = "seq") -> DataFrame:
    """A decimal string from 1 in the order of the stream."""
    s = Stream(df, keys, by).position(out)
    return s.df.withColumn(out, F.col(out).cast("string"))


def replay(df: DataFrame, speed: float = 1.0, keys: Sequence[str] = ORDER, by: Sequence[str] = (), ts: str = "ts", out: str = "emit_us") -> DataFrame:
    """When each row is due: microseconds after the first, gaps divided by the speed (<= 0 counts as 1).

    A gap is measured from the last row with a time; it is 0 if the time is null or went back.
    """
    speed = 1.0 if speed <= 0 else speed
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    s = Stream(df, keys, by).last_before(at, "_was", ignore_nulls=True)
    gap = F.greatest(F.coalesce(at - F.col("_was"), F.lit(0)), F.lit(0))
    s = s.running_sum(gap, "_sum")
    return s.df.withColumn(out, F.floor(F.col("_sum") / F.lit(float(speed))).cast("long")).drop("_was", "_sum")
