from __future__ import annotations

import hashlib
import zlib

from axismap.llm import ogg
from hypothesis import given, settings
from hypothesis import strategies as st


def plain_crc(data: bytes) -> int:
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


@given(st.binary(max_size=200))
def test_crc(data):
    assert ogg.page_crc(data) == plain_crc(data)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=2000), min_size=1, max_size=6), st.lists(st.integers(0, 2), max_size=3))
def test_packets_round_trip(packets, scale):
    packets = packets + [b"z" * (255 * 2), b"y" * (255 * 256 * (len(scale) % 2) + 5)]
    pages = ogg.stream_pages(7, [(p, k) for k, p in enumerate(packets)])
    s = ogg.decode(b"".join(p for _, p in pages))[7]
    assert s.packets == packets and not s.bad_pages and not s.lost and s.ended and s.pages == len(pages)
    assert s.granules[-1] == len(packets) - 1


def test_two_streams_are_told_apart_and_timed():
    payload = bytes(range(256)) * 64
    streams = ogg.decode(ogg.encode(payload, 16000))
    assert len(streams) == 2 and ogg.payload_of(streams)[:2] == (payload, 16000)
    sound = next(s for s in streams.values() if s.packets[0].startswith(ogg.PCM_MAGIC))
    assert ogg.timestamps(sound) == [None, *(min(len(payload), (k + 1) * ogg.PACKET_SAMPLES) / ogg.SAMPLE_RATE for k in range(4))]


def test_pages_of_both_streams_alternate_and_packets_cross_pages():
    payload = bytes(k * 7 % 251 for k in range(300_032))
    data = ogg.encode(payload, len(payload))
    pages = list(ogg.pages_of(data))
    order = [serial for _, _, serial, *_ in pages]
    changes = sum(a != b for a, b in zip(order, order[1:], strict=False))
    assert changes >= 8 and any(kind & ogg.CONTINUED for kind, *_ in pages)
    times = {}
    for _, granule, serial, *_ in pages:
        assert granule == ogg.NO_GRANULE or granule >= times.get(serial, 0)
        times[serial] = granule
    assert ogg.payload_of(ogg.decode(data))[:2] == (payload, len(payload))
    for at in (len(data) // 3, len(data) - 3):
        hurt = bytearray(data)
        hurt[at] ^= 1
        assert ogg.payload_of(ogg.decode(bytes(hurt))) is None


def test_feature_by_plain_arithmetic():
    raw = bytes(range(256)) + b"some text, " * 40
    payload = raw + b"\0" * (-len(raw) % 64)
    streams = ogg.decode(ogg.encode(payload, len(raw)))
    x = [b - 128 for b in payload]
    quarter, energy, at = len(x) // 4, [], 0
    for k in range(4):
        n = quarter + (k < len(x) % 4)
        energy.append(int(sum(v * v for v in x[at : at + n]) / n))
        at += n
    crossings = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:], strict=False))
    want = f"ms={round(len(x) / 8)};packets={-(-len(x) // ogg.PACKET_SAMPLES)};mean={sum(x) / len(x):.3f};rms={(sum(v * v for v in x) / len(x)) ** 0.5:.3f};crossings={crossings};peak={max(map(abs, x))};energy={','.join(map(str, energy))}"
    assert ogg.features(payload, ogg.payload_of(streams)[2]) == want


def test_damaged_and_null_media_and_clashing_names(spark):
    whole = ogg.encode(b"x" * 64, 3)
    rows = [(1, whole), (2, None), (3, b""), (4, b"no container"), (5, whole[:-5]), (6, whole[:40] + b"!" + whole[41:])]
    df = spark.createDataFrame([(k, "kept", m) for k, m in rows], "doc_id long, n_bytes string, media binary")
    got = {r.doc_id: r for r in ogg.read_media(df, keep=("doc_id", "n_bytes")).collect()}
    assert got[1].n_bytes_ == 3 and got[1].n_bytes == "kept" and got[2].media_bytes is None
    assert all(got[k].n_bytes_ is None and got[k].media_bytes == len(dict(rows)[k]) for k in (3, 4, 5, 6))
    assert {r.doc_id for r in ogg.packets(df).collect()} == {1, 5, 6}
    clash = spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, media string")
    again = ogg.to_media(clash, keep=("doc_id", "text", "media"))
    assert again.columns == ["doc_id", "text", "media", "media_"]
    assert ogg.read_media(again, keep=("doc_id", "media"), column="media_").first().n_bytes == 1


def test_a_damaged_page_is_found_and_the_rest_read():
    packets = [(b"a" * 100, 1), (b"b" * 70_000, 2), (b"c" * 50, 3)]
    pages = [p for _, p in ogg.stream_pages(1, packets)]
    hurt = bytearray(pages[1])
    hurt[-1] ^= 1
    s = ogg.decode(pages[0] + b"junk" + bytes(hurt) + b"".join(pages[2:]))[1]
    assert s.bad_pages == 1 and s.lost == 1 and s.packets == [b"a" * 100, b"c" * 50]
    assert ogg.payload_of({1: s}) is None


def test_media_of_odd_rows(docs, odd_rows):
    got = ogg.read_media(ogg.to_media(docs(odd_rows))).collect()
    assert len(got) == len(odd_rows)
    for (_, t), r in zip(sorted(odd_rows, key=lambda x: (x[0] is None, x[0] or 0)), sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0)), strict=True):
        raw = (t or "").encode()
        want = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert r.bad_pages == 0 and r.n_streams == 2
    same = {(r.media_sha256, r.feature) for r in got if r.doc_id in (7, 8)}
    assert len(same) == 1
    assert ogg.read_media(ogg.to_media(docs([]))).count() == 0


def test_packets_table(docs):
    rows = ogg.packets(ogg.to_media(docs([(1, "x" * 9000)]))).orderBy("serial", "packet").collect()
    sound = [r for r in rows if r.seconds is not None]
    assert b"".join(r.data for r in sound).rstrip(b"\0") == b"x" * 9000 and len({r.serial for r in rows}) == 2
