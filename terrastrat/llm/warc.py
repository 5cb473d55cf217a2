"""WARC archives: writing captures with revisits, reading records back and assembling transactions.

A capture is a request, a response (or a revisit of one with an equal payload) and a metadata record.
Response and metadata name the request in WARC-Concurrent-To; assembly joins the three record types on
that identifier into one nested row a capture. Archives are written by Spark's text writer with the
record separator as line end, so any store that Spark writes will do, and read as whole files of a
bounded size.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastrat.session import cut, shared_folder, small_join, written

LINE = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Uncompressed bytes of an archive file, about; a file is held whole by the task that reads it.
FILE_BYTES = 32 << 20


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the payload's SHA-1: each five hexadecimal digits are four letters."""
    digest = F.sha1(payload)
    digits, letters = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), digits, letters)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ([F.lit("-")] if a > 1 else []) + [F.substring(h, a, n)]], F.lit(">"))


def _record(kind: Column | str, identity: Column, content: str, block: Column, *headers: tuple[str, Column]) -> Column:
    """One record without the separator that follows it; headers of null value are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), identity),
        F.lit(f"WARC-Date: {DATE}"),
        *[F.concat(F.lit(f"{name}: "), value) for name, value in headers],
        F.lit(f"Content-Type: {content}"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(LINE, *head), F.lit(LINE * 2), block)


def write_archives(pages: DataFrame, folder: str, least: int = 0, codec: str = "gzip") -> None:
    """Writes every row of ``pages (page_id, url, html)`` as a capture.

    Among rows with equal payloads of at least *least* bytes those of the largest page_id are
    responses and the others revisit them; null is the smallest page_id. A null payload is empty; a
    null address is about:blank. Repeated rows are captures of their own, each with its own record
    identifiers; revisits refer to the one that stands last in the input.
    """
    payload = F.coalesce("html", F.lit(""))
    # files are cut alike on both reads below, so a row's place is the same in each
    rows = pages.select("page_id", "url", payload.alias("payload"), F.monotonically_increasing_id().alias("place"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("bytes", F.octet_length("payload"))
    sizes = rows.agg(F.avg("bytes")).first()[0] or 1.0
    same = rows.filter(F.col("bytes") >= least).groupBy(F.col("digest").alias("_d")).agg(F.count("*").alias("n"), F.max(F.struct("page_id", "place")).alias("first"))
    same = cut(same.filter("n > 1").select("_d", F.col("first.page_id").alias("first"), F.col("first.place").cast("string").alias("first_place")))
    rows = small_join(rows, same, (F.col("digest") == F.col("_d")) & (F.col("bytes") >= least), "left")
    rows = rows.withColumn("place", F.col("place").cast("string"))
    revisit = F.col("_d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    response_id = lambda p, place: _urn(F.lit("response"), p, place, F.col("digest"))
    url = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), "[\r\n]+", " ")
    rows = rows.select(
        page.alias("page"),
        url.alias("url"),
        "payload",
        "digest",
        revisit.alias("revisit"),
        F.coalesce(F.col("first").cast("string"), F.lit("")).alias("first"),
        "first_place",
        "bytes",
        "place",
        _urn(F.lit("request"), page, "place").alias("request"),
    )
    uri = ("WARC-Target-URI", F.col("url"))
    concurrent = ("WARC-Concurrent-To", F.col("request"))
    request = _record("request", F.col("request"), "application/http; msgtype=request", F.concat(F.lit("GET "), "url", F.lit(f" HTTP/1.1{LINE}{LINE}")), uri)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "), F.col("bytes").cast("string"), F.lit(LINE * 2))
    response = _record(
        F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.when(F.col("revisit"), _urn(F.lit("revisit"), F.col("page"), F.col("place"))).otherwise(response_id(F.col("page"), F.col("place"))),
        "application/http; msgtype=response",
        F.concat(http, F.when(F.col("revisit"), "").otherwise(F.col("payload"))),
        uri,
        concurrent,
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        ("WARC-Refers-To", F.when(F.col("revisit"), response_id(F.col("first"), F.col("first_place")))),
        ("WARC-Profile", F.when(F.col("revisit"), PROFILE)),
    )
    metadata = _record("metadata", _urn(F.lit("metadata"), "page", "place"), "application/warc-fields", F.concat(F.lit("page_id: "), "page", F.lit(LINE)), uri, concurrent)
    rows.select(F.concat_ws(LINE * 2, request, response, metadata).alias("value")).write.option("lineSep", LINE * 2).option("compression", codec).option(
        "maxRecordsPerFile", max(1, int(FILE_BYTES / (sizes + 1200)))
    ).text(folder)


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, plain or of gzip members."""
    source = io.BytesIO(content)
    file = io.BufferedReader(gzip.GzipFile(fileobj=source)) if content[:2] == b"\x1f\x8b" else source
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers = {}
        while (line := file.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers.get("content-length", 0))
        block = file.read(size)
        if len(block) < size:
            raise ValueError("the last record is cut short")
        yield headers, block


RECORD = "record_id string, type string, uri string, date string, concurrent_to string, refers_to string, payload_bytes long, payload_digest string, page_id string"


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives in *folder*; payload figures come from the payload itself, or for revisits from their headers."""

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, block in records(content.as_py()):
                    kind, size, digest, page = h.get("warc-type"), None, None, None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    elif kind == "revisit":
                        http = dict(x.lower().split(":", 1) for x in block.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
                        size, digest = int(http.get("content-length", 0)), h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    elif kind == "metadata":
                        page = dict(x.split(":", 1) for x in block.decode("utf-8", "replace").split("\r\n") if ":" in x).get("page_id", "").strip() or None
                    rows.append((h.get("warc-record-id"), kind, h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), size, digest, page))
                if rows:
                    names = [x.split()[0] for x in RECORD.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "payload_bytes" else pa.string()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.filter("length > 0").select("content").mapInArrow(parse, RECORD)


def transactions(records_of: DataFrame) -> DataFrame:
    """One row a capture: ``(capture_id, request, response, metadata)``, the last three nested records.

    The request's identifier names the capture. A response or revisit without its request makes a
    capture of its own; metadata that fits none is left out; several metadata records of a capture
    count as the least of them, several responses make a row each.
    """
    nested = F.struct(*records_of.columns)
    of = lambda *kinds: records_of.filter(F.col("type").isin(*kinds))
    request = of("request").select(F.col("record_id").alias("capture_id"), nested.alias("request")).dropDuplicates(["capture_id"])
    response = of("response", "revisit").select(F.coalesce("concurrent_to", "record_id").alias("capture_id"), nested.alias("response"))
    metadata = of("metadata").groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.min(nested).alias("metadata"))
    return response.join(request, "capture_id", "left").join(metadata, "capture_id", "left").select("capture_id", "request", "response", "metadata")


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """Assembled captures of all archives in *folder*."""
    return transactions(written(read_records(spark, folder)))


def op5_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back: payload figures and what revisits refer to."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages.select(F.col("page_id"), F.col("url"), F.col("html")), folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    rows = cut(captures(spark, folder).select(F.col("metadata.page_id").cast("long").alias("page_id"), "response"))
    first = cut(rows.filter("response.type = 'response'").groupBy(F.col("response.record_id").alias("_id")).agg(F.max("page_id").alias("refers_to")))
    seen = rows.filter("response.type = 'revisit'")
    revisits = small_join(seen, first, seen["response.refers_to"] == first["_id"], "left").select("page_id", "response", "refers_to")
    whole = rows.filter("response.type = 'response'").select("page_id", "response", F.lit(None).cast("long").alias("refers_to")).unionByName(revisits)
    return whole.select("page_id", "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"), "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
q AS (
  SELECT page_id, payload, h, max(page_id) OVER (PARTITION BY h) AS first,
    list_transform(range(8), lambda i: ('0x' || substr(h, (5 * i + 1)::INTEGER, 5))::BIGINT) AS v
  FROM p)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
  array_to_string(list_transform(v, lambda x: array_to_string(list_transform([32768, 1024, 32, 1],
    lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x // d) % 32 + 1)::INTEGER, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM q
"""
