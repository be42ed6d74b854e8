"""Content-addressed web archive.

Payload bytes are stored once per distinct content under their SHA-256; the exact record headers are a separate table;
original records come back through a join on the digest. A payload is verified against its digest when it is read.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Record layout and the base 32 alphabet.
VERSION, DATE = "WARC/1.1", "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_of_hex(hexadecimal: Column, n_digits: int = 40) -> Column:
    """Upper-case base 32 of a hexadecimal string whose length is a multiple of five digits (20 bits, four letters)."""
    groups = [F.lpad(F.conv(F.substring(hexadecimal, i + 1, 5), 16, 32), 4, "0") for i in range(0, n_digits, 5)]
    return F.translate(F.concat(*groups), _DIGITS, BASE32)


def _uuid(kind: str, digest: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind), digest))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _line(name: str, value: Column) -> Column:
    """A header line; line ends inside a value are percent-encoded, and so is the sign of what looks like that already, so
    ``_field`` gives the value back. A null value leaves the line out, an empty one does not."""
    marked = F.regexp_replace(value.cast("string"), "%(?=0D|0A|25)", "%25")
    safe = F.replace(F.replace(marked, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def archive(pages: DataFrame, least_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """The two tables of the archive of ``pages`` (page_id, url, html): headers (digest, header: the exact header block)
    and payloads (digest, payload), one row per distinct payload.

    Of records with equal payloads of at least ``least_bytes`` bytes, that with the largest page_id is the response and
    the others are revisits of it; smaller ones are all responses. A null html is an empty payload; a null url leaves
    its header out, any other comes back as it was; a record with a null page_id revisits the response if one has an id, and is a response otherwise.
    A repeated row gives a repeated record; the payload is still stored once. An empty table gives two empty tables."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    hashed = pages.select("page_id", "url", body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # The size belongs to the digest; the payload itself meets its copies only as one row per digest and map task.
    payloads = hashed.groupBy("digest").agg(F.first("payload").alias("payload"))
    facts = hashed.select("page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("bytes"))
    chosen = facts.groupBy("digest").agg(F.max("page_id").alias("response_id")).withColumnRenamed("digest", "_digest")
    records = facts.join(chosen, F.col("digest") == F.col("_digest"))
    revisit = (F.col("bytes") >= least_bytes) & F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(
        F.col("response_id"))
    kind = F.when(revisit, "revisit").otherwise("response")
    target = lambda c: F.concat(F.lit("<urn:uuid:"), _uuid("page", F.coalesce(c.cast("string"), F.lit("null"))), F.lit(">"))
    header = F.concat(
        F.lit(f"{VERSION}\r\n"), _line("WARC-Type", kind), _line("WARC-Record-ID", target(F.col("page_id"))),
        _line("WARC-Date", F.lit(DATE)), _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1")))),
        _line("WARC-Refers-To", F.when(revisit, target(F.col("response_id")))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Page-Number", F.col("page_id")),
        _line("WARC-Refers-To-Page-Number", F.when(revisit, F.col("response_id"))),
        _line("WARC-Payload-Length", F.col("bytes")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, 0).otherwise(F.col("bytes"))), F.lit("\r\n"))
    return records.select("digest", header.alias("header")), payloads


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> None:
    """Write the archive of ``pages`` below ``folder``: ``headers`` and ``payloads``, both Parquet."""
    headers, payloads = archive(pages, least_bytes)
    headers.write.parquet(f"{folder}/headers")
    payloads.write.parquet(f"{folder}/payloads")


def _field(name: str, kind: str = "string") -> Column:
    """The value of a header line, null where there is none."""
    value = F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1)
    ends = F.replace(F.replace(value, F.lit("%0D"), F.lit("\r")), F.lit("%0A"), F.lit("\n"))
    return F.when(F.contains("header", F.lit(f"\r\n{name}: ")), F.regexp_replace(ends, "%25(?=0D|0A|25)", "%").cast(kind))


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """The records of an archive without payloads: digest, page_id, url, record_type, payload_digest, payload_bytes,
    refers_to and the exact header block."""
    return spark.read.parquet(f"{folder}/headers").select(
        "digest", _field("WARC-Page-Number", "long").alias("page_id"), _field("WARC-Target-URI").alias("url"),
        _field("WARC-Type").alias("record_type"),
        F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        _field("WARC-Payload-Length", "long").alias("payload_bytes"),
        _field("WARC-Refers-To-Page-Number", "long").alias("refers_to"), "header")


def verified_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """The stored payloads (digest, payload, sha1, bytes). A payload that does not have the digest it is stored under
    raises an error."""
    stored = spark.read.parquet(f"{folder}/payloads")
    good = F.sha2("payload", 256) == F.col("digest")
    payload = F.when(good, F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match its digest "), "digest")).cast("binary"))
    return stored.select("digest", payload.alias("payload")).select(
        "digest", "payload", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("bytes"))


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The original records: the columns of ``read_headers``, the payload (of revisits, that of the response), and
    ``record``: the exact bytes of the record."""
    payloads = verified_payloads(spark, folder).select(F.col("digest").alias("_digest"), "payload")
    rows = read_headers(spark, folder).join(payloads, F.col("digest") == F.col("_digest")).drop("_digest")
    block = F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return rows.withColumn("record", F.concat(
        F.encode("header", "UTF-8"), block, F.encode(F.lit("\r\n\r\n"), "UTF-8")))


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, with size and digest taken from the
    stored, verified payload. Only facts about the payloads are joined, not the payloads."""
    facts = verified_payloads(spark, folder).select(
        F.col("digest").alias("_digest"), "sha1", F.col("bytes").cast("long").alias("payload_bytes"))
    rows = read_headers(spark, folder).drop("payload_bytes").join(facts, F.col("digest") == F.col("_digest"))
    checked = F.when(F.col("payload_digest") == base32_of_hex(F.col("sha1")), F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("record and payload differ in digest "), "digest")))
    return rows.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


_LETTERS = " || ".join(
    f"substr('{BASE32}', ((('0x' || substr(h, {i + 1}, 5))::BIGINT >> {shift}) & 31)::INT + 1, 1)"
    for i in range(0, 40, 5) for shift in (15, 10, 5, 0))
ORACLE = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
  m AS (SELECT html, max(page_id) AS best FROM p GROUP BY html)
  SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes, {_LETTERS} AS payload_digest,
    CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
  FROM p JOIN m ON p.html = m.html"""
