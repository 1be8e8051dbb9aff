"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit packing. Built-in functions only.

The hashes of a text's five-word shingles are binned once, by their upper bits; each bin keeps its least. To find the
least of all bins in one primitive sort, the largest possible hash of every bin is added first: after sorting, the first
hash of a bin is its least, or that mark if the bin is empty. An empty bin borrows from the first non-empty bin of its
own fixed random sequence of bins (optimal densification). The lowest four bits of each bin are packed as one
hexadecimal digit. Two fingerprints' share of equal digits, corrected for the 1/16 that agree by chance, estimates the
Jaccard similarity of the texts' shingles.

Defined results: a null text counts as empty; a text of fewer than five words, but at least one, has one shingle; a text
without a word has the empty fingerprint, which is like another empty one (1) and unlike all others (0); rows that repeat
an id follow each other by text; null ids come last; a single document is its own next.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 5
BINS, BIN_BITS = 256, 8
DIGIT_BITS = 4
PROBES = 8
# Documents that follow each other are found within ranges of ids: COARSE quantiles, each cut evenly into as many parts
# as the rows ask for: LEAST_ROWS a range up to MANY ranges (small tables keep all tasks busy), never more than MOST_ROWS.
COARSE, MANY, LEAST_ROWS, MOST_ROWS = 64, 4096, 48, 4096

_rng = random.Random(77)
_SEQUENCE = [_rng.randrange(BINS) for _ in range(PROBES * BINS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


_MARK = (1 << (64 - BIN_BITS)) - 1
_MARKS = [_signed((b << (64 - BIN_BITS)) | _MARK) for b in range(BINS)]


def _longs(values, kind: str) -> Column:
    return F.array(*[F.lit(v).cast(kind) for v in values])


def add_fingerprint(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """df with string column ``out``; columns named _fp_... are this function's own."""
    df = df.withColumn("_fp_w", F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+"), ""))
    w = F.col("_fp_w")
    shingle = lambda i: F.xxhash64(*[F.get(w, i + F.lit(j)) for j in range(WIDTH)])
    hashes = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - WIDTH, F.lit(0))), shingle)
    df = df.withColumn("_fp_s", F.when(F.size(w) > 0, F.sort_array(F.concat(hashes, _longs(_MARKS, "long"))))).drop("_fp_w")
    s = F.col("_fp_s")
    far = 64 - BIN_BITS
    first = F.filter(s, lambda x, i: (i == 0) | (F.shiftrightunsigned(x, far) != F.shiftrightunsigned(F.get(s, i - 1), far)))
    # in signed order the bins run from the middle on; any fixed order does
    df = df.withColumn("_fp_d", F.transform(first, lambda x: F.when(x.bitwiseAND(F.lit(_MARK)) != _MARK, x))).drop("_fp_s")
    d, sequence = F.col("_fp_d"), _longs(_SEQUENCE, "int")

    def filled(x: Column, i: Column) -> Column:
        probes = [F.get(d, F.get(sequence, i + F.lit(BINS * a))) for a in range(PROBES)]
        held = F.filter(d, lambda y: y.isNotNull())
        rest = F.array_min(F.transform(held, lambda y: F.struct(F.xxhash64(i, F.shiftrightunsigned(y, far)).alias("o"), y.alias("y"))))["y"]
        return F.coalesce(x, *probes, rest)

    digits = F.array(*[F.lit(c) for c in "0123456789abcdef"])
    packed = F.array_join(F.transform(F.transform(d, filled), lambda y: F.get(digits, y.bitwiseAND(F.lit(15)).cast("int"))), "")
    return df.withColumn(out, F.when(d.isNull(), "").otherwise(packed)).drop("_fp_d")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1, of two fingerprints: equal digits, less those equal by chance."""
    part = lambda x, c: F.conv(F.substr(x, c * 8 + 1, F.lit(8)), 16, 10).cast("long")

    def equal(c: Column) -> Column:
        x = part(a, c).bitwiseXOR(part(b, c))
        x = x.bitwiseOR(F.shiftright(x, 1))
        x = x.bitwiseOR(F.shiftright(x, 2)).bitwiseAND(F.lit(0x11111111).cast("long"))
        return F.lit(8) - F.bit_count(x)

    same = F.aggregate(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), F.lit(0), lambda acc, c: acc + equal(c))
    chance = 1 / (1 << DIGIT_BITS)
    estimate = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - F.lit(chance)) / F.lit(1 - chance))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(estimate)


def parts_of(rows: int) -> int:
    """Into how many parts each quantile is cut."""
    return max(1, -(-max(min(rows // LEAST_ROWS, MANY), rows // MOST_ROWS) // COARSE))


def with_next(docs: DataFrame, key: str, text: str, extra: list[str], add, tie: str) -> DataFrame:
    """docs (key long not null, tie, text) with next_<column> for text and each of extra: of the next document by descending key.

    Equal keys are in the order of ``tie``, then of the text. ``add`` computes the extra columns. Ids are cut into ranges
    by quantiles and, inside, evenly; each range also gets the first document of the range that follows, as a guest, so
    that one shuffle of the texts serves all. Only one row a range meets in one task. A repeated id is in one range.
    """
    counted = docs.agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("hi")).first()
    n, hi = counted["n"], counted["hi"]
    if not n:
        return add(docs).withColumns({f"next_{c}": F.col(c) for c in [text, *extra]})
    cuts = sorted({max(-(1 << 63), min(int(x), (1 << 63) - 1)) for x in docs.stat.approxQuantile(key, [i / COARSE for i in range(COARSE)], 0.002)})
    fine = parts_of(n)
    lows, highs = _longs(cuts, "long"), _longs([*cuts[1:], max(hi, cuts[-1]) + 1 if hi < (1 << 63) - 1 else hi], "long")
    k = F.col(key)
    at = F.greatest(F.size(F.filter(lows, lambda x: x <= k)) - 1, F.lit(0))
    low, high = F.get(lows, F.col("_at")), F.get(highs, F.col("_at"))
    inside = F.floor((k.cast("double") - low.cast("double")) * fine / F.greatest(high.cast("double") - low.cast("double"), F.lit(1.0)))
    inside = F.least(F.greatest(inside, F.lit(0)), F.lit(fine - 1))

    def ranged(df: DataFrame) -> DataFrame:
        return df.withColumn("_at", at).withColumn("_range", (F.col("_at") * F.lit(fine).cast("long") + inside).cast("long")).drop("_at")

    # one row a range
    one = Window.partitionBy(F.lit(1)).orderBy(F.desc("_range"))
    heads = ranged(docs.select(key)).groupBy("_range").agg(F.max(key).alias("top"))
    top = F.max_by("top", "_range").over(Window.partitionBy(F.lit(1)))
    heads = heads.select("_range", F.coalesce(F.lead("top").over(one), top).alias("top"))
    few = n <= MANY * MOST_ROWS  # so there are at most COARSE * (MANY / COARSE + 1) ranges
    guests = docs.join(F.broadcast(heads) if few else heads, k == F.col("top")).groupBy("_range", "top").agg(F.min(F.struct(tie, text)).alias("_first"))
    guests = guests.select("_range", F.col("top").alias(key), F.col("_first")[tie].alias(tie), F.col("_first")[text].alias(text))
    both = add(ranged(docs).select("_range", key, tie, text, F.lit(False).alias("_guest")).unionByName(guests.withColumn("_guest", F.lit(True))))
    follow = Window.partitionBy("_range").orderBy("_guest", F.desc(key), tie, text)
    return both.withColumns({f"next_{c}": F.lead(c).over(follow) for c in [text, *extra]}).filter("not _guest").drop("_range", "_guest")


def edited(text: Column, following: Column) -> Column:
    """The text with its last third of code points replaced by as many first ones of the following text (or all)."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - third), F.substr(following, F.lit(1), third))


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row a row of docs."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k"), F.col(id_col).isNull().alias("z"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = with_next(rows, "k", "t", ["f"], lambda df: add_fingerprint(df, "t", "f"), "z")
    rows = rows.withColumn("e", edited(F.col("t"), F.col("next_t"))).select("k", "z", F.length("t").cast("long").alias("n_chars"), "e", "f", "next_f")
    rows = add_fingerprint(rows, "e", "g")
    return rows.select(
        F.when(~F.col("z"), F.col("k")).alias(id_col), "n_chars", F.sha2("e", 256).alias("edited_sha256"), F.col("f").alias("fingerprint"), F.col("g").alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("g")).alias("near_edited"), likeness(F.col("f"), F.col("next_f")).alias("near_next"),
    )
