"""Content-addressed WARC archive.

Writing splits every record into a payload, kept once under its verified SHA-256 (and compressed), and the
exact header block, kept per record. Reading joins headers with payloads by digest, rebuilds the original record bytes,
and checks length and digest again.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, scratch, table

RECORD_DATE = "2026-01-01T00:00:00Z"
_END = b"\r\n\r\n"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data = [(html or "").encode("utf-8") for html in b.column(2).to_pylist()]
        yield pa.record_batch(
            [
                b.column(0), b.column(1),
                pa.array([hashlib.sha256(x).digest() for x in data], pa.binary()),
                pa.array([_base32_sha1(x) for x in data], pa.string()),
                pa.array([len(x) for x in data], pa.int64()),
            ],
            ["page_id", "url", "sha256", "sha1", "payload_bytes"],
        )


def _base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sha256, compressed payload), once per digest and batch."""
    for b in batches:
        found = {hashlib.sha256(x).digest(): x for x in ((html or "").encode("utf-8") for html in b.column(0).to_pylist())}
        yield pa.record_batch([pa.array(found, pa.binary()), pa.array([zlib.compress(x, 6) for x in found.values()], pa.binary())], ["sha256", "body"])


def _clean(url: str | None) -> str:
    """A header value stays on its line."""
    return re.sub(r"[\r\n]+", " ", url or "")


def header_block(page_id: int | None, url: str | None, kind: str, sha1: str, payload_bytes: int, refers_to: int | None) -> bytes:
    """The exact bytes before the record's content; Content-Length is that of the stored content (0 for a revisit)."""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {RECORD_DATE}",
        f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha1:{sha1}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if kind == 'revisit' else payload_bytes}"]
    return "\r\n".join(lines).encode("utf-8") + _END


def _headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = b.to_pylist()
        heads = [header_block(r["page_id"], r["url"], r["record_type"], r["sha1"], r["payload_bytes"], r["refers_to"]) for r in rows]
        yield pa.record_batch([b.column("page_id"), b.column("sha256"), b.column("record_type"), pa.array(heads, pa.binary())], ["page_id", "sha256", "record_type", "header"])


def write_archive(pages: DataFrame, path: str, min_payload: int = 0) -> None:
    """Write pages (page_id, url, html) as an archive: path/payloads and path/headers, both Parquet.

    Of records with equal payloads of at least min_payload bytes, the one with the largest page_id is the response and
    the others are revisits that refer to it; smaller payloads are responses throughout. Rows that repeat both page_id
    and payload get the same type. A null html is an empty payload; null page_ids come last among equals, and a group that
    has only null page_ids holds responses. The payload's digest is computed where the bytes are, so only
    compressed payloads and digests move. A digest shared by a third of all rows is combined before the shuffle.
    """
    records = map_arrow(pages.select("page_id", "url", "html"), _digested, "page_id long, url string, sha256 binary, sha1 string, payload_bytes long")
    records.write.option("compression", "zstd").parquet(f"{path}/digests")
    records = pages.sparkSession.read.parquet(f"{path}/digests")
    map_arrow(pages.select("html"), _bodies, "sha256 binary, body binary").groupBy("sha256").agg(F.first("body").alias("body")).write.option("compression", "none").parquet(f"{path}/payloads")
    leaders = records.groupBy("sha256").agg(F.max("page_id").alias("leader"), F.count("*").alias("copies"))
    # only digests that occur more than once need a look-up
    shared = leaders.where("copies > 1").select("sha256", "leader")
    typed = (
        records.select("page_id", "url", "sha256", "sha1", "payload_bytes")
        .join(shared, "sha256", "left")
        .withColumn("revisit", (F.col("payload_bytes") >= min_payload) & F.col("leader").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("leader")))
        .select(
            "page_id", "url", "sha256", "sha1", "payload_bytes",
            F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"),
            F.when(F.col("revisit"), F.col("leader")).alias("refers_to"),
        )
    )
    map_arrow(typed, _headed, "page_id long, sha256 binary, record_type string, header binary").write.option("compression", "zstd").parquet(f"{path}/headers")


_FIELD = re.compile(rb"^([A-Za-z-]+): (.*)$", re.M)
_META = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def parse_header(header: bytes) -> dict[str, str]:
    return {k.decode(): v.rstrip(b"\r").decode("utf-8") for k, v in _FIELD.findall(header)}


def _page(urn: str | None) -> int | None:
    number = (urn or "").rpartition(":")[2].rstrip(">")
    return None if number in ("", "None") else int(number)


def _described(header: bytes, sha1: str, size: int) -> tuple:
    """What a header says, checked against the payload it stands for."""
    h = parse_header(header)
    if h["WARC-Payload-Digest"] != f"sha1:{sha1}":
        raise ValueError(f"{h['WARC-Record-ID']}: the payload is not the one that was written")
    revisit = h["WARC-Type"] == "revisit"
    if int(h["Content-Length"]) != (0 if revisit else size):
        raise ValueError(f"{h['WARC-Record-ID']}: wrong length")
    return _page(h["WARC-Record-ID"]), size, sha1, h["WARC-Type"], _page(h["WARC-Refers-To"]) if revisit else None


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]


_NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def _verified(digest: bytes, body: bytes) -> bytes:
    payload = zlib.decompress(body)
    if hashlib.sha256(payload).digest() != digest:
        raise ValueError(f"payload {digest.hex()} is damaged")
    return payload


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Header, payload and record end, put together again and parsed."""
    for b in batches:
        rows, records = [], []
        for digest, header, body in zip(*(b.column(n).to_pylist() for n in ("sha256", "header", "body")), strict=True):
            payload = _verified(digest, body)
            rows.append(_described(header, _base32_sha1(payload), len(payload)))
            records.append(header + payload + _END)
        yield pa.record_batch([*_columns(rows), pa.array(records, pa.binary())], [*_NAMES, "record"])


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data = [_verified(d, x) for d, x in zip(b.column("sha256").to_pylist(), b.column("body").to_pylist(), strict=True)]
        yield pa.record_batch([b.column("sha256"), pa.array([_base32_sha1(x) for x in data], pa.string()), pa.array([len(x) for x in data], pa.int64())], ["sha256", "sha1", "size"])


def _referring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        headers = b.column("header").to_pylist()
        rows = [_described(*x) for x in zip(headers, b.column("sha1").to_pylist(), b.column("size").to_pylist(), strict=True)]
        yield pa.record_batch([*_columns(rows), pa.array([h + _END for h in headers], pa.binary())], [*_NAMES, "record"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record of an archive: page_id, payload_bytes, payload_digest, record_type, refers_to, record (exact bytes).

    Responses are rebuilt by a join of headers with payloads on the digest. Revisits hold no payload of their own, so
    they join only the digest and length of the payload that they stand for: a third of all rows may be
    revisits of one payload without copying it. A damaged payload or a header that disagrees with it raises an error.
    """
    headers, store = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    schema = f"{_META}, record binary"
    responses = map_arrow(headers.where("record_type = 'response'").join(store, "sha256").select("sha256", "header", "body"), _rebuilt, schema)
    sizes = map_arrow(store, _sized, "sha256 binary, sha1 string, size long")
    revisits = map_arrow(headers.where("record_type = 'revisit'").join(sizes, "sha256").select("header", "sha1", "size"), _referring, schema)
    return responses.unionByName(revisits)


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).drop("record")


OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
    translate(concat(
      to_base(CAST(concat('0x', h[1:10]) AS BIGINT), 32, 8), to_base(CAST(concat('0x', h[11:20]) AS BIGINT), 32, 8),
      to_base(CAST(concat('0x', h[21:30]) AS BIGINT), 32, 8), to_base(CAST(concat('0x', h[31:40]) AS BIGINT), 32, 8)),
      '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
    max(page_id) OVER (PARTITION BY html) AS leader
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN leader IS NOT NULL AND page_id IS DISTINCT FROM leader THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN leader IS NOT NULL AND page_id IS DISTINCT FROM leader THEN leader END AS refers_to
FROM d
"""
