"""URL filter: fixed host and path rules, then association rules mined from labelled URLs.

A URL becomes a set of tokens (host labels, domain, top level, path segments with digits folded, file extension, query
keys, scheme). Spark's FP-growth mines the token combinations that are frequent among labelled URLs, with the label
itself as one more item. A combination is a rule if its support and its confidence (share of bad labels) are high
enough, and if no combination with one token less is at least as confident. An inverted index holds each rule once,
under its rarest token: a URL looks up its tokens and checks the found rules' other tokens. Built-in functions only.
How many combinations there are to mine is bounded by their support alone: labelled URLs that share many tokens (long
query strings) have very many frequent combinations.

Defined results: a null URL, or one without ``://``, has empty host and path and no token, and is allowed; URLs that
repeat get equal verdicts; rows with a null id are judged like others; without labelled URLs there is no mined rule.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm._shared import spill

BAD = "label:bad"
# (host, path, verdict); the longest that fits wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
# Rules that are broadcast at a time.
SEND_RULES = 100_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), upper, upper.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty if there is no host part."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL, sorted; an empty array if it has no ``://``."""
    host, path = host_of(url), F.lower(F.regexp_replace(path_of(url), r"[0-9]+", "#"))
    every = F.split(host, r"\.")
    labels = F.array_remove(every, "")
    last, before = F.get(every, F.size(every) - 1), F.get(every, F.size(every) - 2)  # no pattern: long hosts make them slow
    query = F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(""))
    tagged = lambda mark, xs: F.transform(xs, lambda x: F.concat(F.lit(mark), x))
    parts = F.concat(
        tagged("h:", labels),
        tagged("d:", F.filter(F.array(F.when((last != "") & (before != ""), F.concat(before, F.lit("."), last))), lambda x: x.isNotNull())),
        tagged("t:", F.filter(F.array(F.when((last != "") & before.isNotNull(), last)), lambda x: x.isNotNull())),
        tagged("p:", F.array_remove(F.split(path, "/"), "")),
        tagged("x:", F.filter(F.array(F.regexp_extract(path, r"\.([a-z#]+)$", 1)), lambda x: x != "")),
        tagged("q:", F.array_remove(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"^([^=]*)", 1)), "")),
        tagged("s:", F.array(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)))),
    )
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.sort_array(F.array_distinct(parts))).otherwise(F.array().cast("array<string>"))


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The text (host + path) and the verdict of the longest rule that fits, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def mine(labelled: DataFrame, url_col: str = "url", bad_col: str = "bad", min_support: float = 0.001, min_confidence: float = 0.5, min_rows: int = 8) -> DataFrame:
    """rule (sorted tokens), support (rows), confidence: rules that mark a URL as bad. Null labels are left out."""
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "rule array<string>, support long, confidence double, rarest string")
    bad = F.col(bad_col).cast("boolean")
    rows = labelled.filter(bad.isNotNull()).select(tokens_of(F.col(url_col)).alias("tokens"), bad.alias("bad")).filter(F.size("tokens") > 0)
    rows = spill(rows.select(F.when(F.col("bad"), F.array_append("tokens", BAD)).otherwise(F.col("tokens")).alias("items")), "labelled")
    total = rows.count()
    if not total:
        return empty
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, min(1.0, min_rows / total)), numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions"))).fit(rows)
    sets = spill(model.freqItemsets.select(F.sort_array("items").alias("items"), "freq"), "itemsets")
    whole = sets.filter(~F.array_contains("items", BAD)).select(F.col("items").alias("rule"), F.col("freq").alias("n"))
    hits = sets.filter(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("rule"), F.col("freq").alias("support"))
    rules = hits.join(whole, "rule").select("rule", "support", (F.col("support") / F.col("n")).alias("confidence"))
    less = rules.select("rule", F.explode("rule").alias("out")).filter(F.size("rule") > 1).select("rule", F.array_remove(F.col("rule"), F.col("out")).alias("part"))
    known = less.join(rules.select(F.col("rule").alias("part"), F.col("confidence").alias("c")), "part").groupBy("rule").agg(F.max("c").alias("c"))
    rules = rules.filter(F.col("confidence") >= min_confidence).join(known, "rule", "left").filter(F.col("c").isNull() | (F.col("confidence") > F.col("c")))
    rules = rules.select("rule", "support", "confidence")
    single = whole.filter(F.size("rule") == 1).select(F.element_at("rule", 1).alias("token"), F.col("n").alias("seen"))
    key = rules.select("rule", F.explode("rule").alias("token")).join(single, "token")
    key = key.groupBy("rule").agg(F.min_by("token", F.struct("seen", "token")).alias("rarest"))
    return spill(rules.join(key, "rule"), "rules")


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", id_col: str = "page_id", fixed=RULES) -> DataFrame:
    """id, host, path, rule, verdict, confidence (of the most confident mined rule that fits, else null), one row a row.

    Other columns, whatever their names, are left behind.
    """
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("u"))
    base = base.select("id", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"), tokens_of(F.col("u")).alias("tokens"), F.monotonically_increasing_id().alias("row"))
    known = rules.count()
    if known:
        base = spill(base, "urls")  # rows keep their numbers
        # the inverted index, in parts of about SEND_RULES rules: each token looks its rules up where its page is read, and
        # a page's rules meet under its own row number, so that no token, URL or host is a key of a shuffle
        parts, found = -(-known // SEND_RULES), None
        token = base.select("row", F.explode("tokens").alias("token"))
        for part in range(parts):
            index = rules.filter(F.pmod(F.xxhash64("rule"), F.lit(parts)) == part).select(F.col("rarest").alias("token"), "rule", "confidence")
            seen = token.join(F.broadcast(index), "token").select("row", F.struct("confidence", "rule").alias("r"))
            found = seen if found is None else found.unionByName(seen)
        base = base.join(found.groupBy("row").agg(F.collect_list("r").alias("rules")), "row", "left")
        fits = F.filter("rules", lambda r: F.size(F.array_except(r["rule"], F.col("tokens"))) == 0)
        found = base.withColumn("confidence", F.array_max(F.transform(fits, lambda r: r["confidence"])))
    else:
        found = base.withColumn("confidence", F.lit(None).cast("double"))
    text, verdict = fixed_rule(F.col("host"), F.col("path"), fixed)
    mined = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return found.select(F.col("id").alias(id_col), "host", "path", text.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), "confidence")
