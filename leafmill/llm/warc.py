"""Content-addressed WARC archive (operator 7).

``write_archive`` turns every page into a WARC/1.1 record and keeps two tables in the
archive's folder: ``headers`` has each record's exact header bytes with the SHA-256 of
its payload, ``payloads`` has the bytes of each distinct payload once under that digest.
``read_archive`` joins the two, recomputes the digest of every payload, fails on any
difference, and puts the original records together again, byte for byte. ``read_index``
joins the headers with what each payload's bytes give (digests and length, recomputed where
the payload is read), so that payloads do not cross a shuffle to be read: the bytes are
shuffled once, when copies are merged (in each task first, so a hot payload is not gathered).

Of pages with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the largest
page_id is the response and the others are revisits that refer to it; smaller payloads
are always responses. Equality is by SHA-256. A revisit's record has no body of its own
(Content-Length 0); its payload is that of the record that it refers to.

Defined results: null html is the empty payload; a null url writes no target; carriage
returns and line feeds of a url are percent-encoded; a null page_id ranks below every other, and
where all are null each record is a response; rows that repeat the largest page_id are
all responses; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm._common import FEW_FILES, materialize, new_dir, read_table, write_table

MIN_REVISIT = 1000
#: Fixed value: the profile that WARC/1.1 names for revisits of identical payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _payload() -> Column:
    return F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def _clean_url(url: Column) -> Column:
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def write_archive(pages: DataFrame, path: str) -> None:
    """Write the tables ``headers`` and ``payloads`` of ``pages`` (page_id, url, html) below ``path``."""
    spark = pages.sparkSession
    facts = pages.select(
        "page_id",
        "url",
        F.octet_length(_payload()).cast("long").alias("size"),
        F.sha1(_payload()).alias("sha1"),
        F.sha2(_payload(), 256).alias("sha256"),
    )
    write_table(facts, f"{path}/facts")
    facts = spark.read.parquet(f"{path}/facts")
    first = materialize(facts.groupBy("sha256").agg(F.max("page_id").alias("largest")), "first", FEW_FILES)
    sorted_out = facts.join(first, "sha256").withColumn(
        "refers_to",
        F.when(
            (F.col("size") >= MIN_REVISIT) & F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest")),
            F.col("largest"),
        ),
    )
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", _clean_url(F.col("url"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(
            revisit,
            F.concat(line("WARC-Refers-To", _record_id(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE))),
        ).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string")),
        F.lit("\r\n"),
    )
    write_table(sorted_out.select("page_id", "sha256", F.encode(header, "UTF-8").alias("header")), f"{path}/headers")
    payload = pages.select(F.sha2(_payload(), 256).alias("sha256"), _payload().alias("payload"))
    write_table(payload.groupBy("sha256").agg(F.first("payload").alias("payload")), f"{path}/payloads")


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The archive's headers (sha256, header) and its payloads, checked against their digests."""
    headers = spark.read.parquet(f"{path}/headers").select("sha256", "header")
    fits = F.sha2("payload", 256) == F.col("sha256")
    damaged = F.raise_error(F.lit("a payload is damaged")).cast("binary")
    payloads = spark.read.parquet(f"{path}/payloads").select("sha256", F.when(fits, F.col("payload")).otherwise(damaged).alias("payload"))
    return headers, payloads


def _present(column: str, kind: str) -> Column:
    return F.coalesce(column, F.raise_error(F.lit("a payload is missing")).cast(kind)).alias(column)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload): every record put together again; fails on a payload that is missing or damaged."""
    headers, payloads = _tables(spark, path)
    return headers.join(payloads, "sha256", "left").select("header", _present("payload", "binary"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(header, sha1, size): every record's header with the digest and length of its payload's bytes."""
    headers, payloads = _tables(spark, path)
    return headers.join(payloads.select("sha256", *payload_facts()), "sha256", "left").select(
        "header", _present("sha1", "string"), _present("size", "long")
    )


def payload_facts() -> list[Column]:
    """Digest and length of the bytes in ``payload``."""
    return [F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size")]


def record_bytes() -> Column:
    """The whole record as WARC/1.1 writes it; a revisit has no body."""
    revisit = F.decode("header", "UTF-8").startswith("WARC/1.1\r\nWARC-Type: revisit\r\n")
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    return F.concat("header", body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def parsed(records: DataFrame) -> DataFrame:
    """What the records' own headers say of each page, checked against their payloads."""
    return described(records.select("header", *payload_facts()))


def described(index: DataFrame) -> DataFrame:
    """What the headers of (header, sha1, size) say of each page, checked against digest and length of the payload."""
    text = F.decode("header", "UTF-8")
    field = lambda name, pattern: F.nullif(F.regexp_extract(text, f"\r\n{name}: {pattern}\r\n", 1), F.lit(""))
    page = lambda name: F.expr("try_cast(%s as bigint)" % name)
    fields = index.select(
        "sha1",
        "size",
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        field("WARC-Record-ID", "<urn:page:(-?\\d+)>").alias("id"),
        field("WARC-Refers-To", "<urn:page:(-?\\d+)>").alias("to"),
        field("WARC-Payload-Digest", "sha1:([0-9a-f]+)").alias("digest"),
        field("Content-Length", "(\\d+)").cast("long").alias("length"),
    )
    body = F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("size"))
    fits = (F.col("sha1") == F.col("digest")) & (F.col("length") == body)
    return fields.select(
        page("id").alias("page_id"),
        F.col("size").alias("payload_bytes"),
        F.when(fits, F.col("digest")).otherwise(F.raise_error(F.lit("a header does not fit its payload"))).alias(
            "payload_digest"
        ),
        "record_type",
        page("to").alias("refers_to"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "warc")
    write_archive(read_table(spark, sf_dir, "pages"), path)
    return described(read_index(spark, path))
