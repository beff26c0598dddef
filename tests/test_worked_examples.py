"""Small literal cases for each rule."""

from __future__ import annotations

import pytest
from axismap.functions.coords import group_name
from axismap.operators import canonical, chain, coarsen, members, query
from axismap.plans.align_map import AlignMap, AlignMapBuilder
from axismap.schema import MEMBERS, RUNS, MapError
from pyspark.sql import functions as F


def runs(spark, rows):
    return spark.createDataFrame([(0, a, 0, b, n, s) for a, b, n, s in rows], RUNS)


def shown(df):
    return sorted((r.a, r.b, r.len, r.strand) for r in df.collect())


def built(spark, rows, **close):
    b = AlignMapBuilder(spark, "paf").add_members("a", [("s", 1000)]).add_members("b", [("t", 1000)])
    return b.add_runs(runs(spark, rows)).close(**close)


def test_canonical_runs_merge_per_diagonal(spark):
    got = canonical.canonical_runs(runs(spark, [(20, 30, 5, 0), (10, 20, 10, 0), (12, 22, 3, 0), (50, 40, 5, 1), (55, 35, 5, 1)]))
    assert shown(got) == [(10, 20, 15, 0), (50, 35, 10, 1)]


@pytest.mark.parametrize("width", [1, 7, 64, 1 << 20])
def test_canonical_runs_do_not_depend_on_bins(spark, width):
    rows = [(k * 3, 100 + k * 3, 3 + k % 2, 0) for k in range(40)] + [(k * 5, 500 - k * 5, 4, 1) for k in range(20)]
    assert shown(canonical.canonical_runs(runs(spark, rows), width)) == shown(canonical.canonical_runs(runs(spark, rows)))


def test_overlap_is_refused_or_forces_order_b(spark):
    rows = [(10, 20, 10, 0), (15, 60, 10, 0)]
    with pytest.raises(MapError, match="1 runs overlap"):
        built(spark, rows)
    m = built(spark, rows, allow_overlap=True)
    assert m.meta_value("order") == "b" and m.meta_value("axis_a_overlaps") == "yes"


def test_overlapping_query_and_empty_window(spark):
    m = built(spark, [(10, 500, 20, 0), (15, 100, 10, 1), (5, 800, 3, 0)], allow_overlap=True)
    w = lambda lo, hi: spark.createDataFrame([(1, 0, lo, hi)], "query_id long, member long, lo long, hi long")
    assert sorted(r.a for r in m.query(w(0, 100)).collect()) == [5, 10, 15]
    assert sorted(r.b for r in m.query(w(17, 18)).collect()) == [107, 507]
    assert m.query(w(17, 17)).count() == 0
    with pytest.raises(MapError):
        m.query(w(9, 3))


def test_bad_runs_are_refused(spark):
    for row in [(-1, 0, 5, 0), (0, 0, 0, 0), (990, 0, 20, 0), (0, 995, 6, 0)]:
        with pytest.raises(MapError, match="CORRUPT"):
            built(spark, [row])
    with pytest.raises(MapError, match="undeclared"):
        AlignMapBuilder(spark, "paf").add_runs(runs(spark, [(0, 0, 5, 0)])).close()


def test_presorted_faults(spark):
    rows = spark.createDataFrame([(0, 0, 1), (0, 10, 2), (1, 0, 3), (0, 20, 4), (0, 15, 5)], "a_member long, a long, seq long")
    got = canonical.check_presorted(rows, "seq").first()
    assert (got.revisited, got.backwards) == (1, 1)


SPANS = [(0, 0, 0, 100, 1000, 1100, 0, 100), (0, 0, 120, 220, 1120, 1220, 0, 100), (0, 0, 240, 340, 1240, 1340, 0, 100), (0, 0, 900000, 900100, 1400, 1500, 0, 100), (0, 0, 500, 600, 5000, 5100, 1, 100), (0, 0, 20, 180, 8000, 8160, 0, 160)]


def spans(spark, rows):
    kinds = "q_member long, t_member long, q_start long, q_end long, t_start long, t_end long, strand int, score long, idx long"
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], kinds)


@pytest.mark.parametrize("turn", [1, -1])
def test_chain_example(spark, turn):
    got = chain.chain(spans(spark, SPANS[::turn]), chain.ChainParams(0, 1, 10000)).orderBy("idx")
    assert [r.chain_id for r in got.collect()][::turn] == [2, 2, 2, 4, 1, 3]
    infos = [tuple(r) for r in chain.chain_infos(got).collect()]
    assert infos == [(2, 220, 300, 3), (3, 160, 160, 1), (1, 100, 100, 1), (4, 100, 100, 1)]
    keep = lambda f: {r.chain_id for r in chain.select_chains(got, f).collect() if r.keep}
    assert keep(0.0) == {1, 2, 4} and keep(1.0) == {1, 2, 3, 4}


def test_chain_against_plain_rule():
    """The vectorised rule against one written pair by pair, on random spans."""
    import random

    rng = random.Random(4)
    for _ in range(200):
        p = chain.ChainParams(rng.choice([0, 3]), rng.choice([0, 1, 2]), rng.choice([5, 20, 100]))
        s = []
        for _ in range(rng.randint(1, 12)):
            qs, ts, n = rng.randint(0, 40), rng.randint(0, 40), rng.randint(1, 9)
            s.append((qs, qs + n, ts, ts + rng.randint(1, 9), rng.randint(1, 20)))
        s.sort(key=lambda x: (x[0], x[2], x[3], x[1]))
        score, prev = [x[4] for x in s], [-1] * len(s)
        for i, (qs, _, ts, _, own) in enumerate(s):
            top = own
            for j in sorted(range(i), key=lambda j: (s[j][3], s[j][1], s[j][0], s[j][2], j), reverse=True):
                qg, tg = qs - s[j][1], ts - s[j][3]
                if 0 <= qg <= p.max_gap and 0 <= tg <= p.max_gap:
                    g = 0 if qg + tg == 0 else p.open + p.extend * (qg + tg)
                    if g < own and own + score[j] - g > top:
                        top, prev[i] = own + score[j] - g, j
            score[i] = top
        root, total = [-1] * len(s), {}
        for r in sorted(range(len(s)), key=lambda i: (score[i], s[i][0], s[i][2], s[i][1], s[i][3], i), reverse=True):
            if root[r] >= 0:
                continue
            total[r], at = score[r], r
            while True:
                root[at] = r
                b = prev[at]
                if b < 0:
                    break
                if root[b] >= 0:
                    total[r] -= score[at] - s[at][4]
                    break
                at = b
        got = chain.solve(s, p)
        assert [g[0] for g in got] == root
        assert [g[1] for g in got] == [total[r] for r in root]


def test_coarsen_drift_and_clip(spark):
    drift = coarsen.chains(runs(spark, [(0, 0, 10, 0), (20, 15, 10, 0), (35, 26, 10, 0)]), "a", 10)
    assert sorted((r.k, r.o, r.len) for r in drift.collect()) == [(0, 0, 30), (35, 26, 10)]
    lengths = spark.createDataFrame([(0, 100)], "member_id long, length long")
    clip = lambda rows: [(r.k, r.o, r.len, r.strand) for r in coarsen.clip_to_members(coarsen.chains(runs(spark, rows), "a", 20), lengths).collect()]
    assert clip([(0, 80, 10, 0), (20, 92, 8, 0)]) == [(0, 80, 20, 0)]
    assert clip([(0, 90, 10, 1), (20, 80, 8, 1)]) == [(8, 80, 20, 1)]


def test_prefix_and_groups(spark):
    names = ["g2.x", "g1.chr2", "g10.chrA", "g1.chr1", "h.y"]
    m = spark.createDataFrame([("a", k, n, 10, None) for k, n in enumerate(names)], MEMBERS)
    count = lambda p: members.by_prefix(m, "a", p).first()["count"]
    assert [count(p) for p in ("g1.", "g10.", "zz.", "")] == [2, 1, 0, 5]
    g = spark.createDataFrame([("a", k, n, s, None) for k, (n, s) in enumerate([("gB.chr2", 200), ("gA.chr1", 100), ("gB.chr1", 300), ("loose", 50), ("gA.chr10", 400)])], MEMBERS)
    put, ids = members.assign_groups(g, ".")
    assert {r.name: r.group_id for r in ids.collect()} == {"gB": 0, "gA": 1}
    assert [r.name for r in members.group_members(put, ids, "a", "gA").collect()] == ["gA.chr1", "gA.chr10"]
    assert put.filter("name = 'loose'").first().group_id is None
    assert {r.group_name: r.total_length for r in members.group_totals(put, ids).collect()} == {"gA": 500, "gB": 500}


def test_group_names(spark):
    cases = [("HG002#1#chr1", "#", 2, "HG002#1"), ("HG003#1#chr2", "#", 1, "HG003"), ("nosep", ".", 1, None), ("GCA_000001635.9.chr1", ".", 2, "GCA_000001635.9"), (".x", ".", 1, None), ("x.", ".", 1, None)]
    for name, sep, n, want in cases:
        assert spark.range(1).select(group_name(F.lit(name), sep, n)).first()[0] == want


def test_two_lengths_are_refused(spark):
    seen = spark.createDataFrame([("a", "x", 5, 1), ("a", "x", 6, 2)], "axis string, name string, length long, seq long")
    with pytest.raises(MapError, match="two lengths"):
        members.from_sightings(seen)


def test_store_round_trip_and_pushdown(spark, tmp_path):
    b = AlignMapBuilder(spark, "chain").add_members("a", [("s", 1000)]).add_members("b", [("t", 1000)])
    b.set_meta("k", "1").set_meta("k", "2").add_section("x.note", b"\x00\xff")
    m = b.add_runs(runs(spark, [(0, 10, 5, 0), (20, 40, 7, 1)])).close()
    m.write(str(tmp_path / "m"))
    again = AlignMap.read(spark, str(tmp_path / "m"))
    assert shown(again.runs) == shown(m.runs) and again.meta_value("k") == "2" and again.section("x.note") == b"\x00\xff"
    from axismap.sources.store import window

    hit = window(again.runs, "a", 0, 0, 6)
    assert hit.count() == 1
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(a_end,0)" in plan and "LessThan(a,6)" in plan
    for bad in (lambda: b.set_meta("", "x"), lambda: b.add_section("note", b""), lambda: b.add_section("x.note", b"")):
        with pytest.raises(MapError):
            bad()


def test_swap_twice_is_the_same(spark):
    m = built(spark, [(0, 10, 5, 0), (20, 40, 7, 1)])
    assert shown(m.swap().swap().runs) == shown(m.runs)


def test_scan_with_repeated_others(spark):
    m = built(spark, [(0, 10, 5, 0), (20, 40, 7, 1)])
    others = spark.createDataFrame([(0,), (0,)], "member_id long")
    assert m.scan("a", others=others).count() == 2
    assert query.extent(m.runs, "b").first().asDict() == {"member_id": 0, "lo": 10, "hi": 47, "runs": 2}


def test_streamed_intervals(spark, tmp_path):
    from axismap.streaming.lift_stream import lift_stream

    m = built(spark, [(0, 10, 50, 0), (60, 400, 40, 1)])
    w = spark.createDataFrame([(1, 0, 5, 70), (2, 0, 55, 58)], "query_id long, member long, lo long, hi long")
    w.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(w.schema).parquet(str(tmp_path / "in"))
    q = lift_stream(m.runs, stream).writeStream.format("memory").queryName("lifted").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.table("lifted").select("query_id", "start", "end", "strand").collect())
    want = sorted((r.query_id, r.start, r.end, r.strand) for r in m.lift(w).collect())
    assert got == want and len(got) == 2
