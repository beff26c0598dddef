"""Maps as they are built, swapped, coarsened, stored and measured."""

from __future__ import annotations

import random

import pytest
from axismap.operators import intervals, query
from axismap.plans.align_map import AlignMap, AlignMapBuilder
from axismap.schema import MapError
from axismap.sources import store

RUN = "a_member long, a long, b_member long, b long, len long, strand int"


def builder(spark, rows, b_length=1000):
    b = AlignMapBuilder(spark, "test").add_members("a", [("s", 100), ("u", 100)]).add_members("b", [("t", b_length)])
    return b.add_runs(spark.createDataFrame(rows, RUN)) if rows else b


def meta(m):
    return {r["key"]: r["value"] for r in m.info().collect()}


def test_swap_follows_the_new_axis(spark):
    m = builder(spark, [(0, 0, 0, 10, 10, 0), (0, 20, 0, 15, 10, 0)]).close()
    assert meta(m)["axis_a_overlaps"] == "no" and m.meta_value("order") == "a"
    with pytest.raises(MapError, match="overlap"):
        m.swap()
    turned = m.swap(allow_overlap=True)
    assert turned.meta_value("order") == "b" and turned.meta_value("axis_a_overlaps") == "yes"
    assert builder(spark, [(0, 0, 0, 10, 10, 0)]).close().swap().meta_value("order") == "a"


def test_coarsened_maps_choose_their_order_anew(spark):
    # joined over gaps, the first line runs over the second
    m = builder(spark, [(0, 0, 0, 0, 10, 0), (0, 12, 0, 500, 3, 1), (0, 20, 0, 20, 10, 0)]).close()
    assert m.coarsen("a", 50).meta_value("axis_a_overlaps") in ("yes", "no")
    own = [tuple(r) for r in m.coarsen("b", 50).runs.select("a", "b", "len").orderBy("a").collect()]
    assert (0, 0, 30) in own and m.coarsen("b", 50).meta_value("axis_a_overlaps") == "yes" and m.coarsen("b", 50).meta_value("order") == "b"


def test_presorted_runs(spark):
    good = spark.createDataFrame([(0, 0, 0, 100, 10, 0, 1), (0, 10, 0, 110, 5, 0, 2), (0, 20, 0, 500, 5, 1, 3), (1, 0, 0, 0, 5, 0, 4)], RUN + ", n long")
    m = builder(spark, []).set_presorted(good, "n").close()
    assert m.runs.count() == 3 and m.meta_value("order") == "a"
    for rows in ([(0, 0, 0, 100, 10, 0, 1), (1, 0, 0, 0, 5, 0, 2), (0, 50, 0, 300, 5, 0, 3)], [(0, 20, 0, 100, 10, 0, 1), (0, 5, 0, 300, 5, 0, 2)]):
        with pytest.raises(MapError, match="presorted"):
            builder(spark, []).set_presorted(spark.createDataFrame(rows, RUN + ", n long"), "n").close()


def test_groups_declared_one_by_one(spark):
    b = AlignMapBuilder(spark, "test").add_members("a", [("gB.chr2", 200), ("gA.chr1", 100), ("gB.chr1", 300), ("loose", 50), ("gA.chr10", 400)]).add_members("b", [("column", 100_000)])
    gb, ga = b.add_group("a", "gB"), b.add_group("a", "gA")
    assert (gb, ga) == (0, 1)
    with pytest.raises(MapError):
        b.add_group("a", "gA")
    with pytest.raises(MapError):
        b.set_member_group("a", 0, 7)
    for m, g in ((0, gb), (2, gb), (1, ga), (4, ga)):
        b.set_member_group("a", m, g)
    b.add_runs(spark.createDataFrame([(k, 0, 0, 1000 * k, 10, 0) for k in range(5)], RUN))
    m = b.close()
    assert [r["name"] for r in m.group_members("a", "gA").collect()] == ["gA.chr1", "gA.chr10"]
    assert {r["key"]: r["value"] for r in m.info().collect()}["group.a.gA"] == "2 sequences 500 bp"
    with pytest.raises(MapError, match="no member"):
        _lost(spark)
    with pytest.raises(MapError):
        AlignMapBuilder(spark, "x").set_params(codec="rot13")


def _lost(spark):
    b = builder(spark, [])
    b.set_member_group("a", 9, b.add_group("a", "g"))
    return b.close()


def test_stored_maps_have_sizes_versions_and_checksums(spark, tmp_path):
    path = str(tmp_path / "m")
    with pytest.raises(MapError):
        AlignMap.read(spark, path)
    builder(spark, [(0, k * 10, 0, k * 20, 5, 0) for k in range(10)]).add_section("x.a", b"abc").set_params(4).close().write(path)
    m = AlignMap.read(spark, path)
    told = meta(m)
    assert int(told["chunks"]) >= 3 and int(told["payload_bytes"]) > 0 and float(told["bytes_per_run"]) > 0
    assert [tuple(r) for r in m.section_list().collect()] == [("x.a", 3)] and m.verify() == "OK"
    # written to where it was read from: the old version stays until the next one is whole
    AlignMap(m.runs.filter("a < 50"), m.members, m.groups, m.meta, m.sections).write(path)
    assert AlignMap.read(spark, path).runs.count() == 5 and m.runs.count() == 10
    for part in (tmp_path / "m").glob("v*/runs/part-*"):
        raw = bytearray(part.read_bytes())
        raw[60:64] = bytes(255 - x for x in raw[60:64])  # within the first pages; the rest of so small a file is its footer
        part.write_bytes(bytes(raw))
        (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception):  # noqa: B017
        AlignMap.read(spark, path).verify()


def test_copied_layout_keeps_sections(spark):
    m = builder(spark, [(0, 0, 0, 0, 5, 0)]).add_section("x.a", b"1").close()
    again = AlignMapBuilder(spark, "test").copy_layout(m).add_section("x.b", b"2").add_runs(m.runs).close()
    assert [r["id"] for r in again.section_list().collect()] == ["x.a", "x.b"] and again.members.count() == 3


def test_ordered_results_and_capped_points(spark):
    m = builder(spark, [(0, 10 * k, 0, 20 * (k % 5), 9, k % 2) for k in range(9)] + [(0, 0, 0, 300, 60, 0)]).close(allow_overlap=True)
    w = spark.createDataFrame([(1, 0, 5, 70), (2, 0, 0, 3)], "query_id long, member long, lo long, hi long")
    rows = [tuple(r[c] for c in query.QUERY_ORDER["a"]) for r in m.query(w, "a", ordered=True).collect()]
    assert rows == sorted(rows) and len(rows) > 8
    p = spark.createDataFrame([(7, 0, 12), (8, 0, 99)], "query_id long, member long, pos long")
    assert [(r["query_id"], r["nth"], r["total"]) for r in m.point(p, "a", cap=1).collect()] == [(7, 0, 2)]
    assert [tuple(r) for r in m.point(p, "a", cap=0).collect()] == [(7, 2)]


@pytest.mark.parametrize("width", [None, 256])
def test_interval_join_over_all_levels(spark, width):
    rng = random.Random(2)
    size = lambda: rng.choice([1, 30, 255, 256, 257, 4096, 4097, 70_000, 2_000_000, 300_000_000])
    runs = [(k, k % 2, rng.randint(0, 4_000_000), size()) for k in range(150)]
    windows = [(k, k % 2, s, s + rng.choice([0, size()])) for k, s in ((k, rng.randint(0, 4_000_000)) for k in range(120))]
    r = spark.createDataFrame(runs, "k long, m long, s long, n long")
    w = spark.createDataFrame(windows, "q long, member long, lo long, hi long")
    got = sorted((x.q, x.k) for x in intervals.interval_join(w, r, "member", "lo", "hi", "m", "s", "n", width).collect())
    assert got == sorted((q, k) for q, m, lo, hi in windows for k, m2, s, n in runs if m == m2 and lo < hi and s < hi and s + n > lo)
    one_long = spark.createDataFrame([(0, 0, 0, 1 << 35)], "k long, m long, s long, n long")
    short = spark.createDataFrame([(5, 0, 100, 110)], "q long, member long, lo long, hi long")
    assert intervals.interval_join(short, one_long, "member", "lo", "hi", "m", "s", "n").count() == 1


def test_old_store_names(spark, tmp_path):
    assert store._versions(spark, str(tmp_path / "none")) == []
