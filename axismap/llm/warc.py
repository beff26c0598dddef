"""WARC: a content-addressed archive.

Each distinct payload is stored once, compressed, under its SHA-256; the exact
header block of every record (WARC headers and HTTP headers) is stored apart with
the digest it refers to. A record is put together again by a join of the two
tables, and its payload is checked against the digest it was stored under.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the
smallest id is a response and the others revisit it; smaller payloads are all
responses. Defined results: a null payload is empty; a null id sorts after all
others and is never referred to unless every equal record has a null id; repeated
rows of the smallest id are all responses; a null url leaves its header out; line
ends and blanks in a url are percent-encoded; an empty table gives empty tables.

Shuffles: one of the distinct payloads to the store (equal payloads meet in each
task first, so a payload held by a third of all rows moves once per task), one
narrow join of digests, and the join that reconstructs, whose large keys the
adaptive skew join can split.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axismap.llm.tables import slices, stash

RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_DATE = "1970-01-01T00:00:00Z"
END = b"\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1, the customary value of WARC-Payload-Digest."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}')}>"


def header_block(key: object, url: str | None, kind: str, refers_to: object, size: int, digest: str) -> bytes:
    """The exact bytes before a record's payload: WARC headers, then HTTP headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {WARC_DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c <= " " else c for c in url))
    if kind == REVISIT:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if kind == REVISIT else size)}"]
    return "\r\n".join(lines).encode() + END + http


def parse_record(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record (a revisit's is empty)."""
    head, _, rest = record.partition(END)
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != END:
        raise ValueError("a record's length is not the stated one")
    http, _, payload = block.partition(END)
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _digests(pages: DataFrame, key: str, url: str, payload: str, with_payload: bool) -> DataFrame:
    slim = pages.select(F.col(key).alias("key"), F.col(url).alias("url") if not with_payload else F.lit(None).cast("string").alias("url"), F.col(payload).alias("payload"))
    kind = slim.schema["key"].dataType.simpleString()

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for b in slices(batches):
            raw = [(x or "").encode() for x in b.column(2).to_pylist()]
            strong = pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary())
            if with_payload:
                yield pa.RecordBatch.from_arrays([b.column(0), strong, pa.array([pack.compress(x) for x in raw], pa.binary())], ["key", "sha256", "body"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), strong, pa.array([len(x) for x in raw], pa.int64()), pa.array([payload_digest(x) for x in raw], pa.string())],
                    ["key", "url", "sha256", "size", "digest"],
                )

    return slim.mapInArrow(run, f"key {kind}, sha256 binary, body binary" if with_payload else f"key {kind}, url string, sha256 binary, size bigint, digest string")


def write_archive(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """(headers, store): headers(key, sha256, header), store(sha256, first_key, body)."""
    store = stash(_digests(pages, key, url, payload, True).groupBy("sha256").agg(F.min("key").alias("first_key"), F.first("body").alias("body")), "warc-store")
    heads = _digests(pages, key, url, payload, False).join(store.select("sha256", "first_key"), "sha256")
    heads = heads.withColumn("kind", F.when((F.col("size") < min_bytes) | F.col("key").eqNullSafe(F.col("first_key")), RESPONSE).otherwise(REVISIT))
    kind = heads.schema["key"].dataType.simpleString()

    def run(batches):
        for b in slices(batches):
            cols = [b.column(k).to_pylist() for k in range(b.num_columns)]
            made = [header_block(k, u, t, f, n, d) for k, u, n, d, t, f in zip(cols[0], cols[1], cols[3], cols[4], cols[5], cols[6], strict=True)]
            refers = pa.array([f if t == REVISIT else None for t, f in zip(cols[5], cols[6], strict=True)], b.column(6).type)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), refers, pa.array(made, pa.binary())], ["key", "sha256", "refers_to", "header"])

    headers = heads.select("key", "url", "sha256", "size", "digest", "kind", "first_key").mapInArrow(run, f"key {kind}, sha256 binary, refers_to {kind}, header binary")
    return stash(headers, "warc-headers"), store


def read_archive(headers: DataFrame, store: DataFrame, with_records: bool = True) -> DataFrame:
    """Every record put together again: key, payload_bytes, payload_digest, record_type, refers_to, record.

    ``record`` is the full original record, payload included, for revisits too;
    with ``with_records=False`` it is built and parsed but not returned.
    """
    joined = headers.join(store.select("sha256", "body"), "sha256").select("key", "sha256", "refers_to", "header", "body")
    kind = joined.schema["key"].dataType.simpleString()

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for b in slices(batches):
            out = []
            for strong, header, body in zip(*(b.column(k).to_pylist() for k in (1, 3, 4)), strict=True):
                payload = unpack.decompress(body)
                if hashlib.sha256(payload).digest() != strong:
                    raise ValueError("a stored payload does not have the digest it is stored under")
                stored = header + END if b"\r\nWARC-Type: revisit\r\n" in header[:64] else header + payload + END
                fields, http, own = parse_record(stored)
                whole = own if fields["WARC-Type"] == RESPONSE else payload
                digest = payload_digest(whole)
                if len(whole) != int(http["Content-Length"]) or fields["WARC-Payload-Digest"] != f"sha1:{digest}":
                    raise ValueError("a record's payload is not what its header states")
                out.append((len(whole), digest, fields["WARC-Type"], header + payload + END if with_records else None))
            cols = [pa.array([r[k] for r in out], t) for k, t in enumerate([pa.int64(), pa.string(), pa.string(), pa.binary()])]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols[:3], b.column(2), cols[3]], ["key", "payload_bytes", "payload_digest", "record_type", "refers_to", "record"])

    return joined.mapInArrow(run, f"key {kind}, payload_bytes bigint, payload_digest string, record_type string, refers_to {kind}, record binary")
