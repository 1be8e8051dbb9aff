"""Command line: python -m timberline.plans.cli --since ... --until ... --severity ... FILE..."""

from __future__ import annotations

import sys
import time
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from timberline.functions.parse import parse_lines
from timberline.operators.aggregate import run_stats, stats_text
from timberline.plans.config import from_args
from timberline.plans.pipeline import process
from timberline.sources.lines import from_stdin, read_lines
from timberline.sources.sinks import as_text


def run(args: Sequence[str], out=sys.stdout, err=sys.stderr, spark: SparkSession | None = None, stdin=sys.stdin) -> int:
    """Writes the lines to ``out`` in file and line order; returns how many. Bad settings raise ValueError."""
    config, files = from_args(args)
    spark = spark or SparkSession.builder.appName("timberline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    began = time.monotonic()
    lines = read_lines(spark, files) if files and files != ["-"] else from_stdin(spark, stdin)
    parsed = parse_lines(lines)
    result = process(parsed, config, by=("source_idx",))
    n = 0
    for row in as_text(result.orderBy("source_idx", "line_no"), config.output_format).toLocalIterator():
        out.write(row["value"] + "\n")
        n += 1
    if config.show_stats:
        # a local iterator doesn't report observed metrics: the statistics are a query of their own
        stats = run_stats(parsed, F.lit(True)).first().asDict() | {"lines_matched": n}
        err.write(stats_text(stats, time.monotonic() - began) + "\n")
    return n


def main() -> int:
    try:
        run(sys.argv[1:])
    except (ValueError, OSError) as e:
        sys.stderr.write(f"timberline: {e}\n")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
