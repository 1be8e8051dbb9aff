"""Mixing sources to target weights: weighted fair queueing. Built-in functions only.

Each source's documents stand in a fixed shuffled order (by the MD5 of the id) and are offered ``repeats`` times over. A
copy's virtual finish time is the words that its source has given by then, divided by the source's weight; of its own
words half count, so that the rounding to whole documents favours neither side. All copies are put in order of that time
by a range sort, and the mix is what comes before the place where the running sum of words reaches the total budget (the
copy that lies across it goes in if its middle is before it). A source that runs out leaves its share to the others.

Running sums go by ranges: the sorted rows are written range by range, each range sums its own rows, and what the ranges
before contribute is one small row a range. No task gets a whole source.

``target`` is what a source would give if documents could be cut: at the virtual time V of the budget every source has
given min(repeats * its words, weight * V). It isn't used to choose.

Defined results: a null text has size 0; a null source is a source of its own, the last; documents of size 0 are never
taken; rows that repeat an id follow each other; a row with a null id stands where the text "null" does; an empty table
gives no rows. Column names that begin with __tl_ are kept for this operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm._shared import drop, join_unique, spill

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The number of words: maximal runs without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(df: DataFrame, keys: list[Column | str], sums: dict[str, Column], name: str) -> tuple[DataFrame, DataFrame]:
    """df with __tl_range, and for each of ``sums`` its running sum, up to and with each row, in the order of the keys.

    The second frame has a row a range, with the sums before it. Both are written tables, or read such. The keys should
    tell rows apart: those that they can't tell apart are in one range, in any order.
    """
    sort = [F.col(k) if isinstance(k, str) else k for k in keys]
    rows = spill(df.repartitionByRange(*sort).withColumn("__tl_range", F.spark_partition_id()), name)
    per = rows.groupBy("__tl_range").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    earlier = Window.orderBy("__tl_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    per = spill(per.select("__tl_range", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"__tl_{k}") for k in sums]), name)
    inside = Window.partitionBy("__tl_range").orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.join(F.broadcast(per), "__tl_range")
    return both.withColumns({k: F.col(f"__tl_{k}") + F.sum(c).over(inside) for k, c in sums.items()}).drop(*[f"__tl_{k}" for k in sums]), per


def targets(sizes: DataFrame, weights=(3, 1, 2), budget: float = 1.5, repeats: int = 2) -> DataFrame:
    """s, source_size, n, start, weight, target for each source of sizes (s, source_size, n), a row a source. Spilled.

    s orders like the sources: code points, null last. start: the words of the sources before. They take the weights in turn.
    """
    one = F.lit(1).cast("long")
    w, _ = running(sizes, ["s"], {"rank": one, "start": F.col("source_size")}, "sources")
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1)
    w = w.drop("__tl_range").withColumns({"start": F.col("start") - F.col("source_size"), "weight": weight, "cap": F.col("source_size") * F.lit(repeats)})
    w, _ = running(w, [F.col("cap") / F.col("weight"), "rank"], {"cap_sum": F.col("cap"), "weight_sum": F.col("weight")}, "sources")
    all_words, all_weight = (w.agg(F.sum("source_size"), F.sum("weight")).first()[i] or 0 for i in (0, 1))
    level = (F.lit(all_words) * F.lit(float(budget)) - (F.col("cap_sum") - F.col("cap"))) / (F.lit(float(all_weight)) - (F.col("weight_sum") - F.col("weight")))
    w = spill(w.withColumn("full", F.col("cap") / F.col("weight") <= level).drop("__tl_range"), "sources")
    gone, gone_weight = w.filter("full").agg(F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    share = F.col("weight") * F.try_divide(F.lit(all_words * float(budget)) - F.lit(gone), F.lit(float(all_weight) - gone_weight))
    return spill(w.select("s", "source_size", "n", "start", "weight", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target")), "targets")


def schedule(docs: DataFrame, weights=(3, 1, 2), budget: float = 1.5, repeats: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, text_key, size, source_size, target, weight, finish (virtual, of the first copy), copies and taken: one row a row of docs.

    text_key: a hash of the text, with which rows that share an id can be told apart. Others columns are left behind.
    """
    source = F.col(source_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.coalesce(F.concat(F.lit("a"), source), F.lit("b")).alias("s"),
        words(F.col(text_col)).alias("size"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")).alias("spot"),
    )
    rows, _ = running(spill(rows, "sizes"), ["s", "spot", "id", "text_key"], {"end": F.col("size")}, "sizes")
    rows = spill(rows.drop("__tl_range"), "ends")
    sizes = rows.groupBy("s").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = targets(sizes, weights, budget, repeats)
    total, budget_words = plan.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0)) * F.lit(float(budget))).first()
    place = F.col("end") - F.col("start")  # words of the source up to the document's end
    joined = join_unique(rows, plan, ["s"], "n", max(1, total))
    rows = spill(joined.select("id", "text_key", "s", "size", "source_size", "target", "weight", place.alias("place")), "placed")
    copy = lambda i: F.struct(
        ((F.col("place") + i * F.col("source_size") - F.col("size") / 2) / F.col("weight")).alias("finish"), "s", (F.col("place") + i * F.col("source_size")).alias("place"),
    )
    copies = rows.filter("size > 0").select("size", F.explode(F.array(*[copy(F.lit(i)) for i in range(repeats)])).alias("copy"))
    cut = _cut(copies.select("copy.*", "size"), ["finish", "s", "place"], budget_words)
    if cut is None:
        count = F.lit(0)
    else:
        last = F.struct(F.lit(cut["finish"]).alias("finish"), F.lit(cut["s"]).alias("s"), F.lit(cut["place"]).cast("long").alias("place"))
        count = sum((F.when((F.col("size") > 0) & (copy(F.lit(i)) <= last), 1).otherwise(0) for i in range(repeats)), F.lit(0))
    return rows.select("id", "text_key", "size", "source_size", "target", "weight", copy(F.lit(0))["finish"].alias("finish"), count.alias("copies"), (count * F.col("size")).cast("long").alias("taken"))


def _cut(copies: DataFrame, keys: list[str], budget: float):
    """The keys of the last copy, in the order of the keys, whose middle is within the budget; None if there is none."""
    rows, before = spill(copies.repartitionByRange(*keys).withColumn("__tl_range", F.spark_partition_id()), "copies"), Window.orderBy("__tl_range").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy("__tl_range").agg(F.sum("size").alias("size"), F.max(F.struct(*keys)).alias("top"))
    per = spill(per.select("__tl_range", "top", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before")), "copies")  # one row a range
    here = per.filter(F.col("before") <= F.lit(float(budget))).orderBy(F.desc("__tl_range")).first()
    if here is None:
        return None
    # the running sum reaches the budget in this range: all ranges before go in, and of this one what is before the cut
    run = F.sum("size").over(Window.partitionBy("__tl_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    inside = rows.filter(F.col("__tl_range") == here["__tl_range"]).withColumn("upto", run + F.lit(here["before"]))
    cut = inside.filter(F.col("upto") - F.col("size") / 2 <= F.lit(float(budget))).agg(F.max(F.struct(*keys)).alias("top")).first()["top"]
    if cut is None:
        earlier = per.filter(F.col("__tl_range") < here["__tl_range"]).agg(F.max("top").alias("top")).first()
        cut = earlier["top"]
    drop(rows, per)
    return cut


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed stream: rows of docs, each as often as it is taken, range-sorted by virtual finish time.

    All columns of docs, none added. Rows that repeat an id and a text are taken alike.
    """
    plan = schedule(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).filter("copies > 0")
    plan = plan.groupBy(F.col("id").alias("__tl_id"), F.col("text_key").alias("__tl_key")).agg(F.max(F.struct("copies", "finish", F.col("source_size").alias("whole"), "weight")).alias("__tl_mix"))
    on = F.col(id_col).eqNullSafe(F.col("__tl_id")) & (F.xxhash64(text_col) == F.col("__tl_key"))
    both = docs.join(plan, on)
    both = both.withColumn("__tl_copy", F.explode(F.sequence(F.lit(0), F.col("__tl_mix.copies") - 1)))
    finish = F.col("__tl_mix.finish") + F.col("__tl_copy") * F.col("__tl_mix.whole") / F.col("__tl_mix.weight")
    both = both.withColumn("__tl_finish", finish).drop("__tl_id", "__tl_key", "__tl_mix", "__tl_copy")
    spread = both.repartitionByRange("__tl_finish", id_col).sortWithinPartitions("__tl_finish", id_col)
    return spread.drop("__tl_finish")
