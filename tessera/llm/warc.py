r"""A content-addressed web archive: payload bytes once by SHA-256, exact record headers beside them.

write_archive makes two tables in a folder. payloads holds each distinct payload once under its digest. records holds one
row per page with the exact bytes of the record's header block (WARC header, and for a response the HTTP header), but no
payload. read_archive joins the two and gives back each WARC/1.1 record byte for byte; a payload whose digest doesn't
match its key fails the read.

Of records with equal payloads of at least MIN_REVISIT bytes, the one with the smallest page_id is the response and the
others are revisits that name it. Smaller payloads are always responses; their bytes are kept once as well.

Defined cases: a null html is an empty payload; a null page_id comes after all others, and is a revisit where another row
holds its payload; of repeated rows of one page_id the first by url is the response, equal urls too are told apart by a
row number; a null url is written as urn:page:<page_id>; control characters and spaces in a url are percent-encoded in
the header alone; an empty table gives empty tables; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import new_folder

MIN_REVISIT = 100
WARC_DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def payload_of(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "UTF-8")


def record_id(page_id: Column, copy: Column) -> Column:
    """A name-based urn:uuid of the page, its payload and, for a repeated row, its number."""
    h = F.md5(F.concat_ws("/", F.lit("page"), F.coalesce(page_id.cast("string"), F.lit("null")), F.col("digest"), copy.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def uri_of(url: Column, page_id: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A"), "[\\x00-\\x20\\x7F]", "%20")
    return F.coalesce(clean, F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null"))))


def write_archive(pages: DataFrame, path: str) -> None:
    """Writes payloads and records below path, from page_id, url and html."""
    spark = pages.sparkSession
    whole = pages.select("page_id", "url", payload_of(F.col("html")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # One shuffle of payloads, after a partial aggregation that folds copies inside each map task.
    whole.groupBy("digest").agg(F.any_value("payload").alias("payload")).withColumn("n_bytes", F.octet_length("payload").cast("long")).write.option(
        "compression", "zstd"
    ).parquet(f"{path}/payloads")
    payloads = spark.read.parquet(f"{path}/payloads").select("digest", "n_bytes")

    heads = whole.select("page_id", "url", "digest")
    # The key of a row: page_id, then url; a number tells wholly equal rows apart. Cells of one page_id are small.
    same_page = Window.partitionBy("page_id", "digest").orderBy(F.col("url").asc_nulls_last())
    heads = heads.withColumn("copy", F.row_number().over(same_page))
    key = F.struct(F.col("page_id").isNull().alias("is_null"), "page_id", "copy")
    firsts = heads.groupBy("digest").agg(F.min(key).alias("first"))
    h, p, f = heads.alias("h"), payloads.alias("p"), firsts.alias("f")
    joined = h.join(f, F.col("h.digest") == F.col("f.digest")).join(p, F.col("h.digest") == F.col("p.digest")).select(
        "h.page_id", "h.url", "h.digest", "h.copy", "f.first", "p.n_bytes"
    )
    is_first = F.col("first.page_id").eqNullSafe(F.col("page_id")) & (F.col("first.copy") == F.col("copy"))
    revisit = (F.col("n_bytes") >= MIN_REVISIT) & ~is_first
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF * 2))
    http = F.when(revisit, F.lit(f"HTTP/1.1 200 OK{CRLF}{CRLF}")).otherwise(http)
    block = F.octet_length("http") + F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("n_bytes"))
    fields = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.col("record_type"), F.lit(f"{CRLF}WARC-Record-ID: "), record_id(F.col("page_id"), F.col("copy")),
        F.lit(f"{CRLF}WARC-Date: {WARC_DATE}{CRLF}WARC-Target-URI: "), uri_of(F.col("url"), F.col("page_id")),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(
            F.col("record_type") == "revisit",
            F.concat(
                F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "),
                record_id(F.col("first.page_id"), F.col("first.copy")),
            ),
        ).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), block.cast("string"), F.lit(CRLF * 2), F.col("http"),
    )
    records = (
        joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("http", http)
        .select(
            "page_id", "url", "digest", record_id(F.col("page_id"), F.col("copy")).alias("record_id"), F.encode(fields, "UTF-8").alias("header"),
            F.when(F.col("record_type") == "revisit", F.col("first.page_id")).alias("first_page"),
        )
    )
    records.write.option("compression", "zstd").parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, first_page, record (exact WARC bytes), payload (null for a revisit), payload_bytes and payload_digest.

    A revisit carries no payload, so it is joined with the payload table for its length alone.
    """
    records = spark.read.parquet(f"{path}/records")
    payloads = spark.read.parquet(f"{path}/payloads")
    text = F.decode("header", "UTF-8")
    field = lambda name: F.regexp_extract(text, f"\r\n{name}: ([^\r]*)\r\n", 1)
    records = records.select("*", F.regexp_extract(text, "\r\nWARC-Type: ([^\r]*)\r\n", 1).alias("record_type"), F.regexp_extract(field("WARC-Payload-Digest"), "^sha256:(.*)$", 1).alias("key"))
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    responses = (
        records.where("record_type = 'response'")
        .join(payloads.select(F.col("digest").alias("key"), "payload"), "key")
        .withColumn("again", F.sha2("payload", 256))
        .withColumn("payload_digest", F.when(F.col("again") == F.col("key"), F.col("again")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest: "), F.col("key")))))
        .select(
            "page_id", "url", "record_type", F.lit(None).cast("long").alias("refers_to"), F.concat("header", "payload", end).alias("record"), "payload",
            F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest",
        )
    )
    revisits = (
        records.where("record_type = 'revisit'")
        .join(payloads.select(F.col("digest").alias("key"), "n_bytes"), "key")
        .select(
            "page_id", "url", "record_type", F.col("first_page").alias("refers_to"), F.concat("header", end).alias("record"), F.lit(None).cast("binary").alias("payload"),
            F.col("n_bytes").alias("payload_bytes"), F.col("key").alias("payload_digest"),
        )
    )
    return responses.unionByName(revisits)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page to an archive in the shared folder and reads the records back.

    payload_bytes and payload_digest of a response come from the bytes of its rebuilt record.
    """
    path = new_folder(spark, "archive")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    archive = read_archive(spark, path)
    body = F.expr("substring(record, length(record) - 3 - payload_bytes, payload_bytes)")
    response = F.col("record_type") == "response"
    checked = archive.withColumn("body", F.when(response, body))
    return checked.select(
        "page_id",
        F.when(response, F.octet_length("body").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha2("body", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.col("refers_to"),
    )


OP5_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN first_page END AS refers_to
FROM f
"""
