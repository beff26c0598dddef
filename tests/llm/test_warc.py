from __future__ import annotations

import base64
import hashlib

import pytest
from axismap.llm import warc

ROWS = [(5, "http://a/ b", "<p>x</p>"), (3, None, "<p>x</p>"), (9, "http://c", None), (2, "http://d", ""), (7, "u", "é" * 40_000), (7, "u", "é" * 40_000), (None, "n", "<p>x</p>"), (None, "m", "lonely")]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, sha256 string")


def test_archive_round_trip(spark):
    headers, store = warc.write_archive(pages(spark, ROWS))
    assert store.count() == len({(h or "") for _, _, h in ROWS})
    got = warc.read_archive(headers, store).collect()
    assert len(got) == len(ROWS)
    for r in got:
        fields, http, payload = warc.parse_record(r.record) if r.record_type == "response" else (None, None, None)
        if fields:
            assert len(payload) == r.payload_bytes and http["Content-Type"].startswith("text/html")
            assert "\r" not in fields.get("WARC-Target-URI", "")
    by = sorted(((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str)
    want = []
    for k, _, h in ROWS:
        raw = (h or "").encode()
        peers = [x for x, _, y in ROWS if (y or "") == (h or "") and x is not None]
        first = min(peers) if peers else None
        kind = "response" if k == first else "revisit"
        want.append((k, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, None if kind == "response" else first))
    assert by == sorted(want, key=str)


def test_small_payloads_are_all_responses(spark):
    headers, store = warc.write_archive(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]), min_bytes=3)
    got = {r.key: r.record_type for r in warc.read_archive(headers, store).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_a_changed_payload_is_refused(spark):
    import zstandard
    from pyspark.errors import PythonException
    from pyspark.sql import functions as F

    headers, store = warc.write_archive(pages(spark, [(1, "u", "ab")]))
    bad = store.withColumn("body", F.lit(bytearray(zstandard.compress(b"zz"))))
    with pytest.raises(PythonException, match="digest"):
        warc.read_archive(headers, bad).collect()


def test_empty_table(spark):
    assert warc.read_archive(*warc.write_archive(pages(spark, []))).count() == 0
