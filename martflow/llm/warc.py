"""A content-addressed WARC archive.

The archive is two tables in the shared folder: ``payloads`` holds every distinct
payload once, under its digests, and ``headers`` the exact header block of every
record with its digest.  A record is its header block, its payload and two line
ends, rebuilt by a join on the digest; reading recomputes both digests from the
stored bytes and compares them with what the header says.

Equal payloads are found by SHA-1, SHA-256 and length together.  The digests are
grouped with partial aggregation, so a payload that a third of all records share
is shipped once per task and not once per record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from martflow.session import fresh_dir

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def base32(hex40: Column) -> Column:
    """Base-32 text of a digest of 40 hex digits: 20 bits give four characters."""
    parts = []
    for i in range(8):
        bits = F.conv(F.substring(hex40, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def _digests(payload: Column) -> list[Column]:
    return [F.sha1(payload).alias("sha1"), F.sha2(payload, 256).alias("sha256"),
            F.octet_length(payload).cast("long").alias("bytes")]


def _urn(page_id: Column, url: Column) -> Column:
    h = F.md5(F.concat_ws("\0", F.coalesce(page_id.cast("string"), F.lit("")), F.coalesce(url, F.lit(""))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"),
                    F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _clean(text: Column) -> Column:
    """A header value has no line ends."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]+", " ")


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
                  min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes one record per row.

    Among records of equal payloads of at least ``min_bytes`` bytes the one with
    the smallest id is a response and the others are revisits of it; smaller ones
    are all responses.  A null payload is empty, a null id sorts last.  Of
    rows that repeat the smallest id with the same payload one is the response.
    ``date`` is the WARC-Date of all records: the table holds no times.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"),
                        F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("page_id", "url", "payload", *_digests(F.col("payload")))
    same = ["sha1", "sha256", "bytes"]
    (rows.groupBy(*same).agg(F.first("payload").alias("payload"))
     .write.parquet(f"{path}/payloads"))

    # Equal (id, url, payload) rows are counted, so exactly one of them is first.
    records = rows.groupBy("page_id", "url", *same).agg(F.count(F.lit(1)).alias("copies"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.coalesce("url", F.lit("")).alias("url"))
    first = rows.select(*same, order.alias("o")).groupBy(*same).agg(F.min("o").alias("first")).select(
        *[F.col(c).alias(f"f_{c}") for c in same], "first")
    joined = records.join(first, F.expr(" and ".join(f"{c} = f_{c}" for c in same)))
    numbered = joined.select("page_id", "url", *same, order.alias("o"), "first",
                             F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    revisit = (F.col("bytes") >= min_bytes) & ~((F.col("o") == F.col("first")) & (F.col("copy") == 1))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    block = F.concat(
        F.lit("WARC/1.1" + END), field("WARC-Type", kind), field("WARC-Record-ID", _urn(F.col("page_id"), F.col("url"))),
        field("WARC-Date", F.lit(date)), field("WARC-Target-URI", _clean(F.col("url"))),
        field("WARC-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        F.when(revisit, F.concat(
            field("WARC-Refers-To", _urn(F.col("first.page_id"), F.col("first.url"))),
            field("WARC-Refers-To-Page-ID", F.coalesce(F.col("first.page_id").cast("string"), F.lit(""))),
            field("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(F.lit("")),
        field("Content-Type", F.lit("text/html; charset=utf-8")),
        field("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))), F.lit(END))
    numbered.select(block.cast("binary").alias("header"), *same).write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """header, payload, payload_bytes, payload_digest, verified: every record of an archive.

    ``payload_digest`` and ``payload_bytes`` are computed from the stored bytes;
    ``verified`` says that they are what the header and the address promise.  A
    record whose payload is missing has nulls there and is not verified.
    """
    schema = "sha1 string, sha256 string, bytes long"
    stored = spark.read.schema(f"{schema}, payload binary").parquet(f"{path}/payloads").select(
        *[F.col(c).alias(f"p_{c}") for c in ("sha1", "sha256", "bytes")], "payload",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32(F.sha1("payload")).alias("payload_digest"), F.sha2("payload", 256).alias("again"))
    headers = spark.read.schema(f"header binary, {schema}").parquet(f"{path}/headers")
    same = F.expr("sha1 = p_sha1 and sha256 = p_sha256 and bytes = p_bytes")
    said = header_field(F.col("header"), "WARC-Payload-Digest")
    ok = (F.col("again") == F.col("sha256")) & (said == F.concat(F.lit("sha1:"), F.col("payload_digest")))
    return headers.join(stored, same, "left").select(
        "header", "payload", "payload_bytes", "payload_digest", F.coalesce(ok, F.lit(False)).alias("verified"))


def header_field(header: Column, name: str) -> Column:
    """A field of a header block, null if it is absent or empty."""
    value = F.regexp_extract(header.cast("string"), rf"(?m)^{name}: ([^\r\n]*)\r?$", 1)
    return F.when(value != "", value)


def record_bytes(records: DataFrame) -> Column:
    """The exact bytes of a record: revisits carry no body of their own."""
    kind = header_field(F.col("header"), "WARC-Type")
    body = F.when(kind == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return F.concat(F.col("header"), body, F.lit(END + END).cast("binary"))


def archived(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, from a written archive."""
    spark = pages.sparkSession
    path = fresh_dir(spark, "warc")
    write_archive(pages, path)
    records = read_archive(spark, path)
    return records.select(
        header_field(F.col("header"), "WARC-Page-ID").cast("long").alias("page_id"), "payload_bytes", "payload_digest",
        header_field(F.col("header"), "WARC-Type").alias("record_type"),
        header_field(F.col("header"), "WARC-Refers-To-Page-ID").cast("long").alias("refers_to"), "verified")
