"""WARC archives, content-addressed: payload bytes once by digest, exact record headers apart, records by joins.

An archive is a folder with two tables. ``payloads`` holds each distinct payload once, under its SHA-256, in as many
buckets by that digest as ``layout`` says. ``headers`` holds, for every record, the exact bytes of its WARC header block
and of its HTTP header, and its SHA-256. A record is its header, an empty line, its block (HTTP header and payload; a
revisit has no payload) and two line ends.

Reading joins headers and payloads by digest (payloads lie in buckets, so only headers are shuffled; digests that many
records share are dealt out), assembles every record, and takes all columns from its bytes. A payload that hasn't its
SHA-256, a declared WARC-Payload-Digest that isn't the payload's, and a Content-Length that isn't the block's raise.

Of records with equal payloads, that with the smallest id is the response and the others are revisits that refer to it.

Defined results: a null payload is empty; payloads of 0 bytes are equal payloads like others; a null URL gives a record
without target; line ends and control characters in a URL are percent-encoded; rows that repeat the smallest id with the
same payload are each a response, their payload is stored once; a row with a null id is a revisit, or a response if no
equal payload has an id; an empty table gives an empty archive.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import _shared
from timberline.llm._shared import join_unique, shared_dir, spill, write as write_table

CRLF = "\r\n"


def base32(sha1_hex: Column) -> Column:
    """Bare upper-case base32 (RFC 4648) of 40 hexadecimal digits: 40 bits at a time are 8 digits."""
    parts = [F.lpad(F.conv(F.substring(sha1_hex, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _safe(url: Column) -> Column:
    for code in [*range(33), 127]:
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def _record_id(of: Column) -> Column:
    h = F.md5(of.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ([F.lit("-")] if a > 1 else []) + [F.substring(h, a, n)]], F.lit(">"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes every row as a record to the archive at ``path``. ``date``: the records' WARC-Date."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    narrow = spill(rows.select("id", "url", F.sha2("payload", 256).alias("sha256"), base32(F.upper(F.sha1("payload"))).alias("sha1"), F.octet_length("payload").cast("long").alias("bytes")), "records")
    owners = spill(narrow.groupBy("sha256").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "owners")
    total = narrow.count()

    # one copy of each payload: copies go before the shuffle, and a hot one comes once from each task
    stored = rows.select(F.sha2("payload", 256).alias("sha256"), "payload").groupBy("sha256").agg(F.first("payload").alias("payload"))
    spark = pages.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))  # the shuffle's own parts: a file each
    table = f"tl_payloads_{uuid.uuid4().hex}"
    stored.write.bucketBy(buckets, "sha256").option("compression", "zstd").option("path", f"{path}/payloads").saveAsTable(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{path}/layout")

    known = join_unique(narrow, owners, ["sha256"], "n", total)
    response = F.col("id").eqNullSafe(F.col("first"))
    own = F.concat_ws("/", F.coalesce(F.col("id").cast("string"), F.lit("none")), "sha256")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    none = F.lit("")
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(response, "response").otherwise("revisit")),
        line("WARC-Record-ID", _record_id(own)),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", _safe(F.col("url"))), none),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(response, none).otherwise(
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", _record_id(F.concat_ws("/", F.coalesce(F.col("first").cast("string"), F.lit("none")), "sha256"))),
                line("X-Refers-To-Page", F.coalesce(F.col("first").cast("string"), F.lit("none"))),
            )
        ),
        F.coalesce(line("X-Page", F.col("id").cast("string")), none),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.length(http) + F.when(response, F.col("bytes")).otherwise(0)).cast("string")),
    )
    write_table(known.select("sha256", header.alias("header"), http.alias("http")), f"{path}/headers")
    _shared.drop(narrow, owners)


def _field(name: str) -> Column:
    found = F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    """sha256, payload, read by buckets, so that a join by sha256 needs no shuffle of them."""
    buckets = spark.read.schema("buckets int").parquet(f"{path}/layout").first()["buckets"]
    table = f"tl_payloads_{uuid.uuid4().hex}"
    place = f"{path}/payloads".replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {table} (sha256 STRING, payload BINARY) USING parquet OPTIONS (path '{place}') CLUSTERED BY (sha256) INTO {buckets} BUCKETS")
    found = spark.table(table).select("sha256", "payload")
    spark.sql(f"DROP TABLE {table}")  # the frame keeps the layout
    return found


def _joined(spark: SparkSession, path: str) -> DataFrame:
    """sha256, header, http, payload: every header with its payload."""
    headers = spark.read.schema("sha256 string, header string, http string").parquet(f"{path}/headers")
    stored = _payloads(spark, path)
    per = spill(headers.groupBy("sha256").agg(F.count(F.lit(1)).alias("n")), "records")
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = per.filter(F.col("n") > max(1, total) / _shared.HOT_SHARE)
    if hot.isEmpty():
        return headers.join(stored, "sha256")
    keys = F.broadcast(hot.select("sha256"))  # fewer than HOT_SHARE digests
    many = join_unique(headers.join(keys, "sha256", "left_semi"), stored.join(F.broadcast(hot), "sha256"), ["sha256"], "n", total, hot)
    return headers.join(keys, "sha256", "left_anti").join(stored, "sha256").unionByName(many)


def records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, target, payload_bytes, payload_digest, record (its exact bytes), payload.

    A revisit's payload is that of the response it refers to. Everything is read from the rebuilt records and verified.
    """
    end = F.lit(CRLF.encode())
    whole = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.lit("a payload doesn't have its digest")).cast("binary"))
    rows = _joined(spark, path).select("header", "http", whole.alias("payload"))
    # the header says itself whether the payload belongs into the record
    block = F.when(F.col("header").contains(f"{CRLF}WARC-Type: response{CRLF}"), F.col("payload")).otherwise(F.lit(b""))
    rows = rows.select(F.concat(F.col("header").cast("binary"), end, F.col("http").cast("binary"), block, end, end).alias("record"), "payload")
    rows = rows.withColumn("head", F.substring_index(F.col("record").cast("string"), CRLF * 2, 1))
    size, digest = _field("Content-Length").try_cast("long"), base32(F.upper(F.sha1("payload")))
    stands = F.octet_length("record") == F.octet_length("head") + F.lit(8) + size
    right = F.coalesce(stands & (_field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), digest)), F.lit(False))
    record = F.when(right, F.col("record")).otherwise(F.raise_error(F.concat(F.lit("a record isn't what its header says: "), F.col("head"))).cast("binary"))
    rows = rows.select(record.alias("record"), "payload", digest.alias("payload_digest"))
    rows = rows.withColumn("head", F.substring_index(F.col("record").cast("string"), CRLF * 2, 1))
    return rows.select(
        _field("X-Page").cast("long").alias("page_id"), _field("WARC-Type").alias("record_type"), _field("X-Refers-To-Page").try_cast("long").alias("refers_to"),
        _field("WARC-Target-URI").alias("target"), F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record", "payload",
    )


def summary(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every rebuilt record."""
    return records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def archive_path(spark: SparkSession) -> str:
    """A new place for an archive in the shared folder."""
    return f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
