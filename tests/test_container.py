"""The binary container: number streams, chunks, round trips in both orders, windows, damage."""

from __future__ import annotations

import random

import numpy as np
import pytest
from axismap.plans.align_map import AlignMap, AlignMapBuilder
from axismap.schema import RUN_COLUMNS, MapError
from axismap.sources import container

RUN = "a_member long, a long, b_member long, b long, len long, strand int"


def plain_varint(v):
    out = bytearray()
    while v > 127:
        out.append(v % 128 + 128)
        v //= 128
    return bytes([*out, v])


def test_number_streams():
    rng = random.Random(1)
    values = [0, 1, 127, 128, 16383, 16384, 2**63 - 1, *(rng.randrange(2 ** rng.randint(1, 63)) for _ in range(500))]
    raw = container.put_varints(np.array(values, np.uint64))
    assert raw == b"".join(map(plain_varint, values)) and container.get_varints(raw, len(values)).tolist() == values
    signed = np.array([0, -1, 1, -2, 2, -(2**62), 2**62], np.int64)
    assert container.fold_sign(signed)[:5].tolist() == [0, 1, 2, 3, 4] and (container.unfold_sign(container.fold_sign(signed)) == signed).all()
    for bad in (raw[:-1], raw + b"\x80", b"\x80" * 11 + b"\x01"):
        with pytest.raises(MapError):
            container.get_varints(bad, len(values) if len(bad) > 20 else 1)
    assert container.put_varints(np.zeros(0, np.uint64)) == b"" and len(container.get_varints(b"", 0)) == 0


def made(spark, overlap, seed=4):
    rng = random.Random(seed)
    rows, at = [], 0
    for k in range(400):
        n = rng.randint(1, 60)
        at = 0 if k % 100 == 0 else at
        b = rng.randint(0, 90_000)
        rows.append((k // 100, rng.randint(0, 20_000) if overlap else at, rng.randint(0, 2), b, n, rng.randint(0, 1)))
        at += n + rng.choice([0, 0, 5, 300])
    b = AlignMapBuilder(spark, "test").add_members("a", [(f"gA.s{9 - k}", 100_000) for k in range(5)]).add_members("b", [(f"t{k}", 100_000) for k in range(4)])
    b.set_meta("note", "tab\there").add_section("x.own", b"\0\1data").add_runs(spark.createDataFrame(rows, RUN))
    return b.close(allow_overlap=overlap, group_sep=".")


def shown(runs):
    return sorted(tuple(r) for r in runs.select(*RUN_COLUMNS).collect())


@pytest.mark.parametrize("overlap", [False, True])
@pytest.mark.parametrize("squeeze", [False, True])
def test_round_trip(spark, tmp_path, overlap, squeeze):
    m, path = made(spark, overlap), str(tmp_path / "x.bin")
    container.write(path, m.runs, m.members, m.groups, m.meta, m.sections, count=16, span=20_000, squeeze=squeeze)
    again = AlignMap(*container.read(spark, path))
    assert shown(again.runs) == shown(m.runs) and container.verify(spark, path) == "OK"
    for table in ("members", "groups", "meta", "sections"):
        assert sorted(map(str, getattr(again, table).collect())) == sorted(map(str, getattr(m, table).collect()))
    c = container.Container(path)
    assert c.by_b == overlap and c.n_chunks > 30 and c.total_runs == m.runs.count() and c.profile == "test"
    e = c.entries(0)
    assert e["n_runs"].max() <= 16 and all(s <= 20_000 or n == 1 for s, n in zip(e["b_span"], e["n_runs"], strict=True))


@pytest.mark.parametrize("overlap", [False, True])
def test_windows_read_what_a_scan_finds(spark, tmp_path, overlap, monkeypatch):
    monkeypatch.setattr(container, "PAGE", 4096)
    m, path = made(spark, overlap), str(tmp_path / "x.bin")
    container.write(path, m.runs, m.members, m.groups, m.meta, m.sections, count=16, span=20_000)
    every = shown(m.runs)
    for axis, at in (("a", 1), ("b", 3)):
        for member, lo, hi in ((0, 0, 100_000), (1, 500, 3000), (2, 40_000, 40_001), (3, 7, 7)):
            got = shown(container.runs(spark, path, axis, member, lo, hi))
            assert got == [r for r in every if r[at - 1] == member and lo < hi and r[at] < hi and r[at] + r[4] > lo]
    with pytest.raises(MapError):
        container.runs(spark, path, "a", 99)


def test_damage_is_found(spark, tmp_path):
    m, path = made(spark, False), tmp_path / "x.bin"
    container.write(str(path), m.runs, m.members, m.groups, m.meta, m.sections, count=16)
    whole = path.read_bytes()
    c = container.Container(str(path))
    places = [9, 20, len(whole) - 20, *(off + n // 2 for off, n, _ in c.sections.values() if n)]
    for at in places:
        hurt = bytearray(whole)
        hurt[at] ^= 4
        path.write_bytes(bytes(hurt))
        with pytest.raises(Exception):  # noqa: B017 (tasks wrap the error)
            container.verify(spark, str(path))
    path.write_bytes(whole[:-40])
    with pytest.raises(MapError):
        container.Container(str(path))
    path.write_bytes(b"short")
    with pytest.raises(MapError):
        container.Container(str(path))


def test_an_empty_map(spark, tmp_path):
    m, path = AlignMapBuilder(spark, "none").close(), str(tmp_path / "x.bin")
    container.write(path, m.runs, m.members, m.groups, m.meta, m.sections)
    assert AlignMap(*container.read(spark, path)).runs.count() == 0 and container.verify(spark, path) == "OK"


def test_chunk_cuts():
    b, n = np.array([0, 10, 500, 20, 2000, 2010]), np.array([5, 5, 5, 5, 3000, 5])
    assert container.cuts(b, n, 100, 1000) == [0, 4, 5] and container.cuts(b, n, 2, 10_000) == [0, 2, 4]
