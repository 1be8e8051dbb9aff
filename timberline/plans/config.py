"""Run configuration and its command-line flags."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from timberline.functions.text import parse_format
from timberline.schema import severity_rank_of

# The accepted timestamp layouts, tried in order.
LAYOUTS = ("%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M:%S")


def parse_time(text: str) -> datetime:
    for layout in LAYOUTS:
        try:
            t = datetime.strptime(text, layout)
        except ValueError:
            continue
        return t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    raise ValueError(f"not a timestamp: {text!r}")


@dataclass(frozen=True)
class Config:
    """since and until are inclusive; 0 turns a numeric setting off; strict=False lets unknown severities mean no limit."""

    since: datetime | None = None
    until: datetime | None = None
    min_severity: str = ""
    grep: str = ""
    invert: bool = False
    dedupe: bool = False
    dedupe_window: float = 0.0
    sample_rate: int = 1
    rate_limit: int = 0
    max_line_len: int = 0
    suffix: str = "..."
    tail_n: int = 0
    output_format: str = "raw"
    show_stats: bool = False
    strict: bool = True

    def validate(self) -> Config:
        if self.since and self.until and not self.since < self.until:
            raise ValueError("since must be before until")
        for name in ("rate_limit", "max_line_len", "tail_n", "dedupe_window", "sample_rate"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} can't be negative")
        if self.min_severity and self.strict:
            severity_rank_of(self.min_severity)
        parse_format(self.output_format)
        return self


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="timberline", description="Slices log files by time, severity and pattern.")
    p.add_argument("files", nargs="*", help="log files; - or none: standard input")
    p.add_argument("--since", "--from", type=parse_time)
    p.add_argument("--until", "--to", type=parse_time)
    p.add_argument("--severity", "--level", dest="min_severity", default="")
    p.add_argument("--grep", default="")
    p.add_argument("--invert", action="store_true")
    p.add_argument("--dedupe", action="store_true")
    p.add_argument("--dedupe-window", type=float, default=0.0, help="seconds")
    p.add_argument("--sample", dest="sample_rate", type=int, default=1)
    p.add_argument("--rate-limit", type=int, default=0, help="lines a second")
    p.add_argument("--max-line-len", type=int, default=0, help="bytes")
    p.add_argument("--tail", dest="tail_n", type=int, default=0)
    p.add_argument("--format", dest="output_format", default="raw")
    p.add_argument("--stats", dest="show_stats", action="store_true")
    p.add_argument("--lenient", dest="strict", action="store_false")
    return p


def from_args(args: Sequence[str]) -> tuple[Config, list[str]]:
    """The configuration and the files of a command line; raises ValueError for settings that don't fit."""
    found = vars(parser().parse_args(args))
    files = found.pop("files")
    return Config(**found).validate(), files
