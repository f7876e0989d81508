"""Content-addressed web archive.

``write_archive`` stores each distinct payload once, below its SHA-256, and keeps the exact
header bytes of every WARC record in a second table.  ``read_archive`` rebuilds the records
by joining both on the address, after checking every stored payload against its digests.

Hot payloads: the smallest page of a payload comes from a map-side combined aggregation,
and only addresses that repeat are joined back, as narrow rows.

Defined results: a null payload is the empty payload; records whose page_id is null count
as the largest id, and if a payload has only such records each is a response; rows that
repeat a response's page_id are responses as well, while their payload is stored once; a null url leaves
out the target line; line breaks in a url are percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# base32 alphabet, WARC version and the date of records made from tables without one.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
VERSION = "WARC/1.1"
NO_DATE = "1970-01-01T00:00:00Z"
CRLF = "\r\n"


def base32_of_hex(hexed: Column, digits: int = 40) -> Column:
    """Upper-case base32 without padding of a hex text; each 10 hex digits (40 bits) give 8 characters."""
    parts = [F.lpad(F.conv(F.substring(hexed, k + 1, 10), 16, 32), 8, "0") for k in range(0, digits, 10)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def payload_digest(payload: Column) -> Column:
    return base32_of_hex(F.sha1(payload))


def _base(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b""))
    return pages.select("page_id", "url", payload.alias("payload")).withColumn("address", F.sha2("payload", 256))


def headers(pages: DataFrame) -> DataFrame:
    """One record per page: exact header bytes and the address of its payload."""
    rows = _base(pages).select("page_id", "url", "address", F.octet_length("payload").alias("n"),
                               payload_digest(F.col("payload")).alias("digest"))
    first = (rows.groupBy("address").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n_records"))
             .filter("n_records > 1").drop("n_records"))
    # Null in first_id: the payload occurs once, or only in records without an id.
    rows = rows.join(first, "address", "left")
    revisit = F.coalesce(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF),
                    line("Content-Length", F.col("n").cast("string")), F.lit(CRLF))
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n"))
    header = F.concat(
        F.lit(VERSION + CRLF),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Date", F.lit(NO_DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", urn(F.col("first_id"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block.cast("string")), F.lit(CRLF), http)
    return rows.select(F.encode(header, "UTF-8").alias("header"), "address")


def payloads(pages: DataFrame) -> DataFrame:
    """Each distinct payload once; copies within a task are combined before the shuffle."""
    return _base(pages).select("address", "payload").dropDuplicates(["address"])


def write_archive(pages: DataFrame, folder: str) -> str:
    """Writes the tables ``records`` and ``payloads`` below ``folder``."""
    payloads(pages).write.parquet(f"{folder}/payloads")
    headers(pages).write.parquet(f"{folder}/records")
    return folder


def verified_payloads(spark: SparkSession, folder: str, with_bytes: bool = True) -> DataFrame:
    """Stored payloads whose bytes still have the address they are stored under; any other raises."""
    stored = spark.read.parquet(f"{folder}/payloads")
    good = F.when(F.sha2("payload", 256) == F.col("address"), F.col("address")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match its address "), F.col("address"))))
    out = [good.alias("address"), F.octet_length("payload").cast("long").alias("payload_bytes"),
           payload_digest(F.col("payload")).alias("payload_digest")]
    return stored.select(*out, *(["payload"] if with_bytes else []))


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract(F.col("head"), rf"(?:^|\r\n){name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def read_archive(spark: SparkSession, folder: str, with_bytes: bool = True) -> DataFrame:
    """The records of an archive: parsed header, verified payload digest and, with
    ``with_bytes``, the payload and the original record bytes."""
    records = spark.read.parquet(f"{folder}/records").withColumn("head", F.decode("header", "UTF-8"))
    records = records.select(
        "header", "address",
        F.regexp_extract(_field("WARC-Record-ID"), r"^<urn:page:(\d+|-\d+)>$", 1).try_cast("long").alias("page_id"),
        _field("WARC-Target-URI").alias("url"), _field("WARC-Type").alias("record_type"),
        F.regexp_extract(_field("WARC-Refers-To"), r"^<urn:page:(.*)>$", 1).try_cast("long").alias("refers_to"),
        F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "").alias("said"))
    whole = records.join(verified_payloads(spark, folder, with_bytes), "address")
    whole = whole.withColumn("payload_digest", F.when(F.col("said") == F.col("payload_digest"), F.col("said")).otherwise(
        F.raise_error(F.concat(F.lit("header and payload disagree at "), F.col("address")))))
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    if with_bytes:
        body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
        whole = whole.withColumn("record", F.concat("header", body, F.lit(b"\r\n\r\n")))
        cols += ["payload", "record"]
    return whole.select(*cols)
