"""Boilerplate lines by distinct-site spread.

Each line that isn't empty (without blanks at its ends) is known by a 64-bit hash. One aggregation gives each hash a
HyperLogLog sketch of the sites that have it; sketches are built before the shuffle and merged after it. A line needs a
spread of ``min_sites``; one of fewer than ``min_chars`` characters, which more sites have by chance, needs
``short_sites``. A line whose estimated spread is clearly at or above what it needs is boilerplate; one whose estimate is
within three standard errors of it gets an exact count of distinct sites. A boilerplate line stays in the document with
the smallest id that has it, and goes from all others.

Defined results: a null text stays null; a null site counts as one site; empty lines are never touched; a line
repeated in one document is one line of one site; rows with a null id count for the spread and keep their
text, unless all rows of a line have null ids; repeated rows lose or keep their lines together; an empty table stays empty.
Column names that begin with __tl_ are kept for this operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm._shared import join_unique, spill

LG_K = 12
# Three standard errors of the sketch's estimate, relative.
MARGIN = 3 * 1.04 / 2 ** (LG_K / 2)
# What is broadcast of the findings at most: 64 bytes a document with any and 4 a line.
SEND_BYTES = 64 << 20


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(" \t\r")))


def boilerplate(docs: DataFrame, min_sites: int = 5, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", short_sites: int = 10) -> DataFrame:
    """h (the line's hash), first (the smallest id that has it), n (its occurrences): the boilerplate lines. Spilled."""
    site = F.coalesce(F.concat(F.lit("s"), F.col(site_col).cast("string")), F.lit("n"))
    lines = docs.select(F.col(id_col).alias("id"), site.alias("site"), F.explode(F.split(text_col, "\n")).alias("line"))
    size = F.length(F.btrim("line", F.lit(" \t\r")))
    need = F.when(size < min_chars, short_sites).otherwise(min_sites)
    lines = lines.filter(size > 0).select("id", "site", need.alias("need"), _key(F.col("line")).alias("h"))
    spread = lines.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.max("need").alias("need"))
    spread = spread.filter(F.col("n") >= F.col("need")).select("h", "first", "n", "need", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = spill(spread.filter(F.col("sites") >= F.col("need") * (1 - MARGIN) - 0.5), "spread")
    near = F.col("sites") <= F.col("need") * (1 + MARGIN) + 0.5
    unsure = spread.filter(near)
    total = spread.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    exact = join_unique(lines.select("h", "site"), unsure.select("h", "n"), ["h"], "n", max(1, total)).distinct()
    exact = exact.groupBy("h").agg(F.count(F.lit(1)).alias("exact"))
    sure = spread.filter(~near).select("h", "first", "n")
    found = unsure.join(exact, "h").filter(F.col("exact") >= F.col("need"))
    return spill(sure.unionByName(found.select("h", "first", "n")), "boilerplate")


def remove(docs: DataFrame, lines: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """docs with the boilerplate lines taken out of the text; removed_col, if given, gets their number.

    An input column named like removed_col is replaced.
    """
    line = F.col("__tl_line")
    cut = docs.select(F.col(id_col).alias("__tl_id"), F.xxhash64(text_col).alias("__tl_text"), F.posexplode(F.split(text_col, "\n")).alias("__tl_pos", "__tl_line"))
    cut = cut.filter(F.length(F.btrim(line, F.lit(" \t\r"))) > 0).select("__tl_id", "__tl_text", "__tl_pos", _key(line).alias("h"))
    total = lines.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hits = join_unique(cut, lines, ["h"], "n", max(1, total)).filter(F.col("__tl_id") != F.col("first"))
    hits = spill(hits.groupBy("__tl_id", "__tl_text").agg(F.collect_set("__tl_pos").alias("__tl_out")), "hits")
    few = hits.agg(F.coalesce(F.sum(F.size("__tl_out") * 4 + 64), F.lit(0))).first()[0] <= SEND_BYTES
    on = (F.col(id_col) == F.col("__tl_id")) & (F.xxhash64(text_col) == F.col("__tl_text"))
    both = docs.join(F.broadcast(hits) if few else hits, on, "left")
    parts = F.split(text_col, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "__tl_out")
    text = F.when(F.col("__tl_out").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("__tl_parts"), i)), "\n"))
    both = both.withColumn("__tl_parts", F.when(F.col("__tl_out").isNotNull(), parts))
    if removed_col:
        both = both.withColumn(removed_col, F.when(F.col("__tl_out").isNull(), 0).otherwise(F.size("__tl_out")).cast("long"))
    return both.withColumn(text_col, text).drop("__tl_id", "__tl_text", "__tl_out", "__tl_parts")
