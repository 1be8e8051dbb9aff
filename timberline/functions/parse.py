"""Text lines to typed rows: timestamps, severities, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.schema import ALIASES, RANK, SEVERITIES

# The line layout and the timestamp layouts.
LINE = r"^([^\t\n\f\r ]+(?:[\t\n\f\r ][^\t\n\f\r ]+)?)[\t\n\f\r ]+(DEBUG|INFO|WARN|WARNING|ERROR|FATAL)[\t\n\f\r ]+([^\n]*)\z"
_ISO = r"\d{4}-\d{2}-\d{2}T\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:\d{2})?"
_PLAIN = r"\d{4}([-/])\d{2}\1\d{2} \d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?"
STAMP = rf"^(?:{_PLAIN}|{_ISO})\z"


def trim_line(raw: Column) -> Column:
    """Without carriage returns and newlines at its end."""
    return F.rtrim(raw, F.lit("\r\n"))


def parse_timestamp(text: Column) -> Column:
    """ISO with or without zone, or date and time with - or / between; null otherwise. Without a zone it is UTC.

    Fractions after a point or comma are cut to microseconds; the hour may have one digit.
    """
    zone = F.when(_has_zone(text), "").otherwise("Z")
    return F.when(text.rlike(STAMP), F.concat(F.translate(text, "/,", "-."), zone).try_cast("timestamp"))


def _has_zone(stamp: Column) -> Column:
    """Of a text with the form of a timestamp: whether it ends in Z or an offset."""
    return stamp.endswith("Z") | F.substring(stamp, -6, 1).isin("+", "-")


def zone_text(stamp: Column) -> Column:
    """The zone as written: Z (also when there is none) or an offset."""
    return F.when(F.substring(stamp, -6, 1).isin("+", "-"), F.substring(stamp, -6, 6)).otherwise("Z")


def severity_rank(name: Column) -> Column:
    """0 for anything but the upper-case names; WARNING ranks as WARN."""
    out = F.lit(0)
    for text, rank in [*RANK.items(), *((a, RANK[n]) for a, n in ALIASES.items())]:
        if rank:
            out = F.when(name == text, rank).otherwise(out)
    return out


def severity_name(rank: Column) -> Column:
    out = F.lit(SEVERITIES[0])
    for i, name in enumerate(SEVERITIES[1:], 1):
        out = F.when(rank == i, name).otherwise(out)
    return out


def parse_lines(df: DataFrame, raw_col: str = "raw", keep_bad: bool = False) -> DataFrame:
    """Adds ts, tz_offset, severity_rank, severity, message. Lines that don't parse go, unless keep_bad (then all null).

    A line parses if the layout fits and its timestamp is one. Columns of these names are replaced.
    """
    raw, nul = F.col(raw_col), "\x00"
    df = df.withColumn(raw_col, trim_line(raw))
    # one match a line: its parts between NULs (a line that has NULs itself is taken apart group by group)
    once = F.split(F.regexp_replace(raw, LINE, f"$1{nul}$2{nul}$3"), nul, 3)
    apart = F.when(raw.rlike(LINE), F.array(*[F.regexp_extract(raw, LINE, i) for i in (1, 2, 3)]))
    parts = F.when(F.instr(raw, nul) == 0, once).otherwise(apart)
    # the arrays hold one item: lambdas name what is computed once, and inline() keeps filters from computing it again
    timed = F.transform(F.array(parts), lambda p: F.struct(F.when(F.size(p) == 3, parse_timestamp(F.get(p, 0))).alias("ts"), p.alias("p")))

    def typed(x: Column) -> Column:
        p, rank = x["p"], severity_rank(F.get(x["p"], 1))
        return F.struct(x["ts"].alias("ts"), zone_text(F.get(p, 0)).alias("tz_offset"), rank.alias("severity_rank"), severity_name(rank).alias("severity"), F.get(p, 2).alias("message"))

    good = F.transform(F.filter(timed, lambda x: x["ts"].isNotNull()), typed)
    df = df.drop(*[c for c in ("ts", "tz_offset", "severity_rank", "severity", "message") if c in df.columns])
    return df.select("*", F.inline_outer(good) if keep_bad else F.inline(good))
