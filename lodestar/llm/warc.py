"""Content-addressed archives of WARC records.

An archive is two tables in one folder.  ``payloads`` holds the bytes of each distinct
payload once, under its SHA-256, its length and a second hash; ``records`` holds the
exact header of each record and the address of its payload.  Records are put together
again by a join on the address.  A payload is hashed anew whenever it is read, and one
that does not have the digest it is stored under is an error.

Payload bytes are shuffled once, when an archive is written, and only one copy of each
from every task; readers that ask for no bytes move none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, free_names

CRLF = "\r\n"
END = CRLF + CRLF
#: What stands between the record header and the payload of a response.
HTTP_HEAD = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{END}"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ADDRESS = ["digest", "length", "check"]


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null; line breaks in values are percent-encoded."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def _urn(*parts: Column) -> Column:
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _field(header: Column, name: str) -> Column:
    """A field of a header; null if it has none.  Values are everything up to the end of the line."""
    return F.nullif(F.regexp_extract(header, rf"(?:^|\r\n){name}: ([^\r\n]*)\r\n", 1), F.lit(""))


@dataclass(frozen=True)
class Archive:
    """The two tables of an archive in a folder that all machines share."""

    path: str

    def payloads(self, spark: SparkSession) -> DataFrame:
        """(digest, length, check, payload, payload_digest, payload_bytes): the last two are taken from the bytes as read."""
        rows = spark.read.schema("digest string, length long, check long, payload binary").parquet(f"{self.path}/payloads")
        got, n = F.sha2("payload", 256), F.octet_length("payload").cast("long")
        sound = (got == F.col("digest")) & (n == F.col("length")) & (F.xxhash64("payload") == F.col("check"))
        verified = F.when(sound, got).otherwise(F.raise_error(F.concat(F.lit("a stored payload does not match its digest "), "digest")))
        return rows.withColumns({"payload_digest": verified, "payload_bytes": n})

    def headers(self, spark: SparkSession) -> DataFrame:
        """(header, digest, length, check)."""
        return spark.read.schema("header string, digest string, length long, check long").parquet(f"{self.path}/records")

    def read(self, spark: SparkSession) -> DataFrame:
        """All records: page_id, url, record_id, record_type, refers_to (a page_id), refers_to_id,
        payload_bytes, payload_digest, header, payload (whole, of revisits too) and record (the exact bytes).

        A plan that selects neither payload nor record moves no payload; it does read and
        verify each one.  A header whose payload is missing is an error.
        """
        h = F.col("header")
        rows = self.headers(spark).join(self.payloads(spark), ADDRESS, "left")
        found = F.coalesce(F.col("payload_digest"), F.raise_error(F.concat(F.lit("no payload is stored for the digest "), "digest")))
        body = F.when(_field(h, "WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
        return rows.select(
            _field(h, "X-Page-Id").cast("long").alias("page_id"),
            _field(h, "WARC-Target-URI").alias("url"),
            _field(h, "WARC-Record-ID").alias("record_id"),
            _field(h, "WARC-Type").alias("record_type"),
            _field(h, "X-Refers-To-Page-Id").cast("long").alias("refers_to"),
            _field(h, "WARC-Refers-To").alias("refers_to_id"),
            "payload_bytes",
            found.alias("payload_digest"),
            "header",
            "payload",
            F.concat(F.encode(F.concat(h, F.lit(CRLF + HTTP_HEAD)), "UTF-8"), body, F.lit(END.encode())).alias("record"),
        )


def write(
    df: DataFrame, path: str | None = None, *, id_: str = "page_id", url: str = "url", content: str = "html",
    date: str = "1970-01-01T00:00:00Z", least: int = 100, scratch: Scratch | None = None,
) -> Archive:
    """Writes a record for each row of ``df`` into a new archive at ``path`` (default: the shared folder).

    Of rows with equal payloads of at least ``least`` bytes the one with the smallest
    id is a response and the others revisit it; smaller payloads are responses each.
    Rows whose ids are equal are records of their own: of the smallest id's rows one is
    the response.  Null ids come after all others and their headers have no id; a
    revisit of a row without an id refers to no id, yet to its record.  A null payload is
    an empty one, a null url has no line in the header, and line breaks in one are
    percent-encoded.  Further columns are left out, whatever their names.  An empty
    table makes an empty archive.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    path = path or f"{scratch.root}/archive"
    (own,) = free_names(df, "uid")
    text = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    rows = df.withColumn(own, F.monotonically_increasing_id())
    rows = rows.select(F.col(own).alias("uid"), F.col(id_).cast("long").alias("id"), F.col(url).cast("string").alias("url"), text.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("length"), F.xxhash64("payload").alias("check"))
    # one copy of each payload leaves a task
    rows.groupBy(*ADDRESS).agg(F.first("payload").alias("payload")).write.option("compression", "zstd").mode("errorifexists").parquet(f"{path}/payloads")
    scratch.release()
    heads = scratch.save(rows.drop("payload"))
    # only repeated payloads have a row here
    first = heads.filter(F.col("length") >= least).groupBy(*ADDRESS).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("id").isNull().alias("last"), "id", "uid")).alias("first"))
    placed = heads.join(first.filter("n > 1").select(*ADDRESS, "first"), ADDRESS, "left")
    again = F.coalesce(F.col("first.uid") != F.col("uid"), F.lit(False))
    record = _urn(F.col("id"), F.col("uid"), F.col("digest"))
    size = F.lit(len(HTTP_HEAD)) + F.when(again, 0).otherwise(F.col("length"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _line("WARC-Record-ID", record),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        _line("WARC-Profile", F.when(again, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(again, _urn(F.col("first.id"), F.col("first.uid"), F.col("digest")))),
        _line("X-Refers-To-Page-Id", F.when(again, F.col("first.id"))),
        _line("X-Page-Id", F.col("id")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", size),
    )
    placed.select(header.alias("header"), *ADDRESS).write.option("compression", "zstd").mode("errorifexists").parquet(f"{path}/records")
    scratch.drop(heads)
    return Archive(path)
