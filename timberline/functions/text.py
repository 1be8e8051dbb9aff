"""Changes to line text: masking, redaction, truncation, colours, JSON."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions.regex import around_group, to_java

REDACTED = "[REDACTED]"
# Terminal colours.
RESET, BOLD, RED, YELLOW, CYAN, WHITE = "\x1b[0m", "\x1b[1m", "\x1b[31m", "\x1b[33m", "\x1b[36m", "\x1b[37m"


def mask(text: Column, patterns: Sequence[str]) -> Column:
    """The text of each pattern's only group becomes [REDACTED] in every match, patterns in order."""
    for p in patterns:
        parts = around_group(p)
        if parts is None:
            text = _mask_slowly(p)(text)
            continue
        java = [to_java(x).text.removeprefix("(?d)") for x in parts]
        text = F.regexp_replace(text, f"(?d)((?:{java[0]}))(?:{java[1]})((?:{java[2]}))" if all(to_java(x).names == () for x in parts) else _fail(p), f"$1{REDACTED}$2")
    return text


def _fail(pattern: str):
    raise ValueError(f"a mask needs exactly one group: {pattern!r}")


def _mask_slowly(pattern: str):
    """For a group inside others, repeated or in an alternative: Arrow batches in Python."""
    to_java(pattern)
    compiled = re.compile(pattern)

    def once(m: re.Match) -> str:
        a, b = m.span(1)
        return m[0] if a < 0 else m.string[m.start() : a] + REDACTED + m.string[b : m.end()]

    @F.arrow_udf("string")
    def of(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else compiled.sub(once, x) for x in column.to_pylist()], pa.string())

    return of


def redact(text: Column, patterns: Sequence[str], placeholder: str = REDACTED) -> Column:
    """Every whole match of each pattern becomes the placeholder, in which $1 stands for a group."""
    if not placeholder:
        placeholder = REDACTED
    for p in patterns:
        text = F.regexp_replace(text, to_java(p).text, placeholder)
    return text


def truncate(text: Column, max_bytes: int, suffix: str = "") -> Column:
    """At most max_bytes bytes of UTF-8 with the suffix, never inside a character; max_bytes <= 0 changes nothing."""
    if max_bytes <= 0:
        return text
    tail = suffix.encode()
    if len(tail) >= max_bytes:
        short = F.lit(tail[:max_bytes].decode(errors="ignore"))
    else:
        raw, most = F.encode(text, "UTF-8"), max_bytes - len(tail)
        inside = lambda k: F.hex(F.substring(raw, k + 1, 1)).between("80", "BF")
        cut = lambda k: F.concat(F.decode(F.substring(raw, 1, k), "UTF-8"), F.lit(suffix))
        short = F.lit(suffix)
        for k in range(max(0, most - 3), most + 1):
            short = F.when(~inside(k), cut(k)).otherwise(short)
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(short)


def _colour(severity: Column) -> Column:
    name = F.upper(severity)
    return F.when(name.isin("ERROR", "FATAL", "CRITICAL"), RED).when(name.isin("WARN", "WARNING"), YELLOW).when(name == "INFO", CYAN).otherwise(WHITE)


def highlight_line(raw: Column, severity: Column, enabled: bool = True) -> Column:
    return F.concat(_colour(severity), raw, F.lit(RESET)) if enabled else raw


def highlight_severity(severity: Column, enabled: bool = True) -> Column:
    return F.concat(F.lit(BOLD), _colour(severity), severity, F.lit(RESET)) if enabled else severity


def to_json(ts: Column, severity: Column, message: Column, tz_offset: Column | None = None) -> Column:
    """{"timestamp", "severity", "message"} in this order, the time to the second; always valid JSON."""
    if tz_offset is None:
        at = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    else:
        hours = F.regexp_extract(tz_offset, r"^([+-]\d{2}):(\d{2})$", 1)
        minutes = F.regexp_extract(tz_offset, r"^([+-]\d{2}):(\d{2})$", 2)
        shift = F.when(tz_offset == "Z", 0).otherwise(F.expr("0") + hours.try_cast("int") * 60 + F.when(hours.startswith("-"), -1).otherwise(1) * minutes.try_cast("int"))
        local = F.timestamp_seconds(F.unix_timestamp(ts) + shift * 60)
        at = F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), tz_offset)
    return F.to_json(F.struct(at.alias("timestamp"), severity.alias("severity"), message.alias("message")))


def parse_format(name: str) -> str:
    """raw or json; other spellings than the lower, title and upper case ones raise."""
    for kind in ("raw", "json"):
        if name in (kind, kind.title(), kind.upper()) or (name == "" and kind == "raw"):
            return kind
    raise ValueError(f"unknown format: {name!r}")
