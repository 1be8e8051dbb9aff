"""The queries of this subpackage: one opN_<name> an operator, and ``pipeline``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import fingerprints, language_id, line_dedup, minhash_dedup, mixing, packing, quality, topk, url_filter, warc
from timberline.llm._shared import until_exit
from timberline.llm.defaults import TOKENIZER, held_out

def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs, train=~held_out())
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"),
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's URL path names the document it shows; that document's labels (poor or toxic) are the URL's."""
    pages, labels = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels")
    number = F.regexp_extract(url_filter.path_of(F.col("url")), r"/([0-9]{1,18})(?:[./]|$)", 1).try_cast("long")
    marked = labels.groupBy("doc_id").agg((F.max((F.col("quality") == 0) | (F.col("toxic") == 1))).alias("bad"))
    rules = url_filter.mine(pages.select("url", number.alias("doc_id")).join(marked, "doc_id"))
    return url_filter.judge(pages, rules)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), train=~held_out())
    found = quality.score(docs.select("doc_id", "text"), model, out="score")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive_path(spark)
    warc.write(_table(spark, sf_dir, "pages"), path)
    until_exit(spark, path)
    return warc.summary(spark, path)


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cleaned = line_dedup.remove(docs, line_dedup.boilerplate(docs), removed_col="removed_lines")
    return cleaned.select("doc_id", "text", "removed_lines")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), TOKENIZER)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.schedule(_table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.classes(_table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    import corpus_pipeline

    own = [op1_language_id, op2_url_filter, op3_quality, op4_warc, op5_exact_topk, op6_line_dedup, op7_packing, op8_mixing, op9_minhash_dedup, op10_fingerprints]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


_BASE32 = (
    "array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(((CAST('0x' || substr(h, 1 + 10 * CAST(i // 8 AS INT), 10) AS BIGINT) "
    ">> CAST(35 - 5 * (i % 8) AS INT)) & 31) AS INT), 1) FOR i IN range(32)], '')"
)


def oracle_sql() -> dict[str, str]:
    return {
        "op6_line_dedup": r"""
            WITH x AS (SELECT doc_id, source, i AS pos, string_split(text, chr(10))[CAST(i AS INT)] AS line
                       FROM documents, range(1, 1 + (SELECT max(len(string_split(text, chr(10)))) FROM documents)) AS r(i)
                       WHERE i <= len(string_split(text, chr(10)))),
                 k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS key FROM x),
                 b AS (SELECT key, min(doc_id) AS first FROM k WHERE key <> '' GROUP BY key
                       HAVING count(DISTINCT coalesce('s' || source, 'n')) >= CASE WHEN length(key) < 20 THEN 10 ELSE 5 END),
                 m AS (SELECT k.*, coalesce(k.doc_id <> b.first, false) AS out FROM k LEFT JOIN b ON k.key = b.key AND k.key <> '')
            SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (NOT m.out), '') END AS text,
                   CAST(count(*) FILTER (m.out) AS BIGINT) AS removed_lines
            FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id, d.text""",
        "op4_warc": f"""
            WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
                 f AS (SELECT body, min(page_id) AS first FROM p GROUP BY body)
            SELECT p.page_id, CAST(strlen(p.body) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
                   CASE WHEN p.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN p.page_id = f.first THEN NULL ELSE f.first END AS refers_to
            FROM p JOIN f ON p.body = f.body""",
        "op5_exact_topk": """
            WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w FROM embeddings
                       WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len(embedding) > 0),
                 s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                              CAST(list_inner_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) AS score
                       FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
                 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
            SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5""",
        "op8_mixing": r"""
            WITH d AS (SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS spot,
                              CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
                 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
                 k AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM s),
                 w AS (SELECT *, CAST([3, 1, 2][1 + (rank - 1) % 3] AS DOUBLE) AS weight, source_size * 2 AS cap FROM k),
                 b AS (SELECT *, sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS total, sum(weight) OVER () AS all_weight,
                              coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before
                       FROM w WINDOW o AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
                 f AS (SELECT *, cap / weight <= (total - cap_before) / (all_weight - weight_before) AS sat FROM b),
                 g AS (SELECT *, sum(CASE WHEN sat THEN cap ELSE 0 END) OVER () AS gone, sum(CASE WHEN sat THEN weight ELSE 0 END) OVER () AS gone_weight FROM f),
                 t AS (SELECT source, source_size, weight, CASE WHEN sat THEN CAST(cap AS DOUBLE) ELSE weight * ((total - gone) / (all_weight - gone_weight)) END AS target FROM g),
                 e AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY spot, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS place FROM d),
                 c AS (SELECT e.doc_id, e.size, t.source, t.source_size, t.target, e.place + i * t.source_size AS place, (e.place + i * t.source_size - e.size / 2) / t.weight AS finish
                       FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source, range(2) AS r(i)),
                 o AS (SELECT *, sum(size) OVER (ORDER BY finish, source IS NULL, source, place ROWS UNBOUNDED PRECEDING) AS upto,
                              (SELECT sum(size) FROM d) * CAST(1.5 AS DOUBLE) AS budget FROM c)
            SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
                   CAST(sum(CASE WHEN upto - size / 2 <= budget THEN size ELSE 0 END) AS BIGINT) AS taken
            FROM o GROUP BY doc_id""",
    }
