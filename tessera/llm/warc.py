"""Operator 5, WARC: archives of gzip members, one per record, and their sequential reader.

Archives are rows of a binary column, in parts of bounded size; a part holds whole
members, so any part, and any sequence of parts, is a WARC file by itself. The reader
takes an archive from its start: it inflates a member in steps, cuts header and block
by Content-Length, and checks the digests of block and payload.

A payload that several pages share is stored once, with the page of the largest id;
the others are revisit records that refer to it.

Defined results: a null html is an empty payload; null urls are written without a
target; a null page_id counts as smaller than any other; rows that repeat the largest
page_id of their payload are responses too. Damaged members, lengths or digests are
told in the columns error and digest_ok, and reading goes on with what follows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import read, stash

#: Bytes of compressed members after which an archive part ends; a longer record is a part of its own.
PART_BYTES = 4 << 20
MIN_REVISIT_BYTES = 0
LEVEL = 5
_STEP = 64 << 10
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def plan_revisits(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload and first: the page that holds the payload, or null for a record with a payload of its own.

    The lean digests are aggregated before they meet the payloads again, so a payload
    that a third of the pages share is one row of the small side.
    """
    pages = df.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.encode(F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    pages = pages.withColumn("digest", F.sha1("payload"))
    shared = pages.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("last").isNotNull())
    shared, _ = stash(shared)  # a table of its own, so that Spark may split a hot payload's side of the join
    revisits = (F.octet_length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("last"))
    return pages.join(shared.hint("merge"), "digest", "left").select("page_id", "url", F.when(F.col("last").isNotNull() & revisits, F.col("last")).alias("first"), "payload")


def _record(kind: str, page: int | None, url: str | None, first: int | None, payload: bytes) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {_name(first)}", f"WARC-Profile: {_PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _name(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _member(record: bytes) -> bytes:
    made = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return made.compress(record) + made.flush()


def write_archives(planned: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """content: the parts of the archives; a task writes its records one after another."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[bytes] = []
        size = 0
        for batch in batches:
            for page, url, first, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part.append(_member(_record("response" if first is None else "revisit", page, url, first, payload)))
                size += len(part[-1])
                if size >= part_bytes:
                    yield pa.record_batch([pa.array([b"".join(part)], pa.binary())], ["content"])
                    part, size = [], 0
        if part:
            yield pa.record_batch([pa.array([b"".join(part)], pa.binary())], ["content"])

    return planned.select("page_id", "url", "first", "payload").mapInArrow(write, "content binary")


def members(archive: bytes) -> Iterator[tuple[bytes | None, str | None]]:
    """What each gzip member holds, inflated in steps; a damaged one gives an error and reading resumes at the next magic bytes."""
    at = 0
    while at < len(archive):
        one, out, i = zlib.decompressobj(31), [], at
        try:
            while not one.eof and i < len(archive):
                out.append(one.decompress(archive[i : i + _STEP]))
                i += _STEP
            if not one.eof:
                yield None, "truncated member"
                return
            at = min(i, len(archive)) - len(one.unused_data)
            yield b"".join(out), None
        except zlib.error as e:
            yield None, f"damaged member: {e}"
            if (at := archive.find(b"\x1f\x8b\x08", at + 1)) < 0:
                return


def parse(record: bytes) -> tuple[dict[str, str], bytes, str | None]:
    """Header fields by lower-case name, the block, and what is wrong."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if not gap or not version.startswith("WARC/"):
        return fields, b"", "no WARC header"
    n = fields.get("content-length", "")
    if not n.isdigit():
        return fields, b"", "no content length"
    block = rest[: int(n)]
    if len(block) < int(n) or rest[int(n) :] != b"\r\n\r\n":
        return fields, block, "content length does not fit"
    return fields, block, None


def _page(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def _http_length(head: bytes) -> tuple[int | None, str | None]:
    """The content length of an HTTP header, if it has one, and what is wrong with it."""
    said = next((x.partition(b":")[2].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    if said is None:
        return None, None
    return (int(said), None) if said.isdigit() and len(said) < 19 else (None, "HTTP content length is no number")


RECORD = {
    "page_id": pa.int64(), "record_type": pa.string(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "digest_ok": pa.bool_(),
    "error": pa.string(), "payload": pa.binary(),
}


def read_archives(archives: DataFrame, content: str = "content", payloads: bool = True) -> DataFrame:
    """The records of WARC files in a binary column, such as spark.read.format("binaryFile") gives."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                out: list[tuple] = []
                for data, error in members(archive or b""):
                    if data is None:
                        out.append((None,) * 7 + (error, None))
                        continue
                    fields, block, error = parse(data)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, said = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    length, wrong = _http_length(http)
                    error = error or wrong
                    fits = fields.get("warc-block-digest", "").removeprefix("sha1:") in ("", base32_sha1(block))
                    if kind == "response":
                        fits, length = fits and said in ("", base32_sha1(payload)) and length in (None, len(payload)), len(payload)
                    out.append((_page(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"), length, said, _page(fields.get("warc-refers-to")), fits, error, payload if payloads else None))
                    if len(out) >= 512:
                        yield _batch(out)
                        out = []
                yield _batch(out)

    return archives.select(F.col(f"`{content}`").cast("binary")).mapInArrow(records, "page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, digest_ok boolean, error string, payload binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(RECORD)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, RECORD.values(), strict=True)], list(RECORD))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives, _ = stash(write_archives(plan_revisits(read(spark, sf_dir, "pages"))))
    return read_archives(archives, payloads=False).drop("payload", "url")


def sql() -> str | None:
    """DuckDB has no base32, so it is spelled out from the hex digits of the digest: 5 bits a character."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), b AS (
  SELECT *, list_transform(range(40), lambda i: CAST(('0x' || substr(h, CAST(i + 1 AS INTEGER), 1)) AS BIGINT)) AS d, max(page_id) OVER (PARTITION BY h) AS last FROM p
)
SELECT page_id, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, payload_bytes,
       list_aggregate(list_transform(range(32), lambda k: substr('{letters}', 1 + CAST(((d[CAST((k * 5) // 4 + 1 AS INTEGER)] * 256 + coalesce(d[CAST((k * 5) // 4 + 2 AS INTEGER)], 0) * 16 + coalesce(d[CAST((k * 5) // 4 + 3 AS INTEGER)], 0)) // CAST(pow(2, 7 - (k * 5) % 4) AS BIGINT)) % 32 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id <> last THEN last END AS refers_to, true AS digest_ok, CAST(NULL AS VARCHAR) AS error
FROM b"""
