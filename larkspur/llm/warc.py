"""WARC archives in which equal payloads are stored once: others are revisit records.

Archives are written and read by Spark's own sources, so any store that Spark reaches will
do, and its commit protocol keeps files of lost or repeated tasks out.
"""

from __future__ import annotations

import datetime
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from larkspur.llm import _kernels as k
from larkspur.llm._shared import join_shared

#: Payloads with fewer bytes are always stored whole.
LEAST_BYTES = 100
#: Records in an archive file at most, and bytes of their payloads unless one alone has more; a reader holds one file.
RECORDS_PER_FILE, BYTES_PER_FILE = 1000, 64 << 20
#: Payload bytes that a reader hands on at once.
BYTES_AT_ONCE = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Extension fields: the ids of pages, as they stand in the table.
PAGE, REFERS = "Larkspur-Page-ID", "Larkspur-Refers-To-Page"
_BETWEEN = "\r\n\r\n"


def revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, digest and refers_to of the pages whose payload an earlier page has.

    Only headers are shuffled: ids, digests and sizes. The least id of a digest is found by
    partial aggregation, and only digests that occur twice are joined back.
    """
    headers = pages.select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    headers = headers.where((F.col("size") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest")
    seen = headers.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"), F.count("*").alias("n"))
    shared = seen.where("last > refers_to").select("digest", "refers_to", "n")
    return join_shared(headers, shared, "digest", headers.agg(F.count("*"))).where("page_id > refers_to").select("digest", "page_id", "refers_to").distinct()


def _record_id(page_id: Column, digest: Column, copy: Column) -> Column:
    """A UUID of the page, its payload and which of several such rows it is."""
    h = F.md5(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("")), digest, copy.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ((F.lit("-"),) if i else ()) + (F.substring(h, a, n),)], F.lit(">"))


def _record(page_id: Column, url: Column, html: Column, digest: Column, refers_to: Column, copy: Column, date: str) -> Column:
    is_revisit = refers_to.isNotNull()
    payload = F.coalesce(html, F.lit(""))
    size = F.octet_length(payload)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(_BETWEEN))
    block = F.when(is_revisit, http).otherwise(F.concat(http, payload))
    safe = F.regexp_replace(url, r"[\x00-\x20]", "%20")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(is_revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), _record_id(page_id, digest, copy),
        F.coalesce(F.concat(F.lit(f"\r\n{PAGE}: "), page_id.cast("string")), F.lit("")), F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), safe), F.lit("")),
        F.lit(f"\r\nWARC-Date: {date}\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha256:"), digest, F.lit("\r\nWARC-Payload-Length: "), size,
        F.coalesce(F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _record_id(refers_to, digest, F.lit(0)), F.lit(f"\r\n{REFERS}: "), refers_to.cast("string")), F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(block), F.lit(_BETWEEN), block,
    )


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, records_per_file: int = RECORDS_PER_FILE, bytes_per_file: int = BYTES_PER_FILE) -> None:
    """Writes one record per row of ``pages`` (page_id, url, html) to gzip files under ``path``.

    Of the rows with one payload of ``least_bytes`` or more, those with the least page_id are
    responses and the others revisit it. Rows without an id are responses; null html is an
    empty payload, a null url gives no target. Other columns are not read. Records have ids of
    their own, rows of one page and payload too, and the date of writing.

    Payloads of up to bytes_per_file / records_per_file share files of that many records;
    larger ones, if there are any, are written by classes of size, fewer to a file.
    """
    date = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    found = revisits(pages, least_bytes).select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), "refers_to")
    size = F.octet_length(F.coalesce("html", F.lit("")))
    # The least class whose payloads fit records_per_file / 8 ** class to a file.
    largest = pages.agg(F.max(size)).first()[0] or 0
    limits = [bytes_per_file // records_per_file]
    while limits[-1] < largest and records_per_file >> 3 * len(limits):
        limits.append(limits[-1] * 8)
    rows = pages.select("page_id", "url", "html").withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    for n, limit in enumerate(limits):
        last = n == len(limits) - 1
        own = rows.where((size > (limits[n - 1] if n else -1)) & (F.lit(True) if last else size <= limit))
        own = own.join(found, (F.col("page_id") == F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
        copy = F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url")) - 1
        records = own.withColumn("copy", copy).select(_record(F.col("page_id"), F.col("url"), F.col("html"), F.col("digest"), F.col("refers_to"), F.col("copy"), date).alias("value"))
        most = 1 if last and largest > limit else max(1, records_per_file >> 3 * n)
        records.write.mode("append").option("lineSep", _BETWEEN).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, by lower-case name, and the block of each record; several gzip members may follow each other."""
    if archive[:2] == b"\x1f\x8b":
        plain = []
        while archive:
            member = zlib.decompressobj(31)
            plain.append(member.decompress(archive))
            archive = member.unused_data
        archive = b"".join(plain)
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        lines = archive[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}
        start = end + 4
        stop = start + int(fields["content-length"])
        yield fields, archive[start:stop]
        at = stop + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload (null in revisits).

    Bytes and digest of a response are those of the payload that is read; a revisit's are in its header.
    """
    schema = T.StructType.fromDDL("page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary")
    number = lambda x: int(x) if x else None

    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows, size = [], 0
                for fields, block in parse(archive.as_py()):
                    page, kind = number(fields.get(PAGE.lower())), fields["warc-type"]
                    if kind == "revisit":
                        rows.append((page, fields.get("warc-target-uri"), kind, number(fields[REFERS.lower()]), int(fields["warc-payload-length"]), fields["warc-payload-digest"].partition(":")[2], None))
                    else:
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        rows.append((page, fields.get("warc-target-uri"), kind, None, len(payload), hashlib.sha256(payload).hexdigest(), payload))
                    size += len(block)
                    if size >= BYTES_AT_ONCE:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(k.tidy(run), schema)


ARCHIVES_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
    f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= {LEAST_BYTES} GROUP BY 1)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, d.payload_digest, CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id > first_id THEN first_id END AS refers_to FROM d LEFT JOIN f ON f.payload_digest = d.payload_digest"""
