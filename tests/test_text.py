"""Random alignments as sets of base pairs, through PAF and chain text, lifts and round trips."""

from __future__ import annotations

import random

import pytest
from axismap.operators import canonical
from axismap.plans.align_map import AlignMap
from axismap.schema import MapError
from axismap.sources import text

SIZES = {"gA.chr1": 900, "gA.chr2": 700, "gB.s1": 800, "gB.s2": 600}


def alignments(seed: int, n: int, function: bool):
    """(q, t, strand, ops, q0, q1, t0, t1) with the base pairs of each."""
    rng, out, taken = random.Random(seed), [], {q: 0 for q in ("gA.chr1", "gA.chr2")}
    while len(out) < n:
        q, t, rev = rng.choice(["gA.chr1", "gA.chr2"]), rng.choice(["gB.s1", "gB.s2"]), rng.random() < 0.4
        ops = []
        for k in range(rng.randint(1, 4)):
            if k:
                ops += [(rng.randint(0, 4), o) for o in rng.sample("ID", 2)]
            ops.append((rng.randint(1, 12), "M"))
        nq, nt = (sum(c for c, o in ops if o in x) for x in ("MI", "MD"))
        q0 = taken[q] + rng.randint(0, 3) if function else rng.randint(0, SIZES[q] - nq)
        t0 = rng.randint(0, SIZES[t] - nt)
        if q0 + nq > SIZES[q]:
            break
        taken[q] = q0 + nq
        pairs, qp, tp = set(), q0 + nq if rev else q0, t0
        for c, o in ops:
            for _ in range(c):
                if o == "M":
                    pairs.add((q, t, rev, qp - 1 if rev else qp, tp))
                qp += (-1 if rev else 1) * (o in "MI")
                tp += o in "MD"
        out.append((q, t, rev, ops, q0, q0 + nq, t0, t0 + nt, pairs))
    return out


def paf_line(x):
    q, t, rev, ops, q0, q1, t0, t1, _ = x
    cigar = "".join(f"{c}{o}" for c, o in ops)
    return f"{q}\t{SIZES[q]}\t{q0}\t{q1}\t{'-' if rev else '+'}\t{t}\t{SIZES[t]}\t{t0}\t{t1}\t0\t0\t255\ttp:A:P\tcg:Z:{cigar}"


def chain_lines(x, number):
    """Target is axis a: blocks along the target of the chain, the query on its own strand."""
    q, t, rev, ops, q0, q1, t0, t1, _ = x
    ops = ops[::-1] if rev else ops  # along axis a forward
    s, e = (SIZES[t] - t1, SIZES[t] - t0) if rev else (t0, t1)
    lines, size, dt, dq = [f"chain 1 {q} {SIZES[q]} + {q0} {q1} {t} {SIZES[t]} {'-' if rev else '+'} {s} {e} {number}"], 0, 0, 0
    for c, o in ops:
        if o == "M":
            if size:
                lines.append(f"{size}\t{dt}\t{dq}")
            size, dt, dq = c, 0, 0
        elif o == "I":
            dt += c
        else:
            dq += c
    return [*lines, str(size), ""]


def pairs_of(runs, members):
    names = {(r.axis, r.member_id): r.name for r in members.collect()}
    return {(names["a", r.a_member], names["b", r.b_member], bool(r.strand), r.a + i, r.b + (r.len - 1 - i if r.strand else i)) for r in runs.collect() for i in range(r.len)}


def in_memory(spark, lines):
    return spark.createDataFrame([(x, "f", k) for k, x in enumerate(lines)], "line string, file string, seq long")


@pytest.mark.parametrize("function", [True, False])
def test_paf_and_chain_say_the_same(spark, function, tmp_path):
    al = alignments(7, 12, function)
    want = set().union(*(x[-1] for x in al))
    (tmp_path / "x.paf").write_text("# head\n\n" + "\n".join(map(paf_line, al)) + "\r\n")
    (tmp_path / "x.chain").write_text("\n".join(y for k, x in enumerate(al) for y in chain_lines(x, k)) + "\n")
    gap = 7 if function else 0
    for build, export, read in ((AlignMap.from_paf, AlignMap.to_paf, text.paf), (AlignMap.from_chain, AlignMap.to_chain, text.ucsc_chain)):
        m = build(spark, str(tmp_path / f"x.{'paf' if read is text.paf else 'chain'}"), allow_overlap=True)
        assert pairs_of(m.runs, m.members) == want
        lines = [y for r in export(m, gap).collect() for y in r.text.split("\n")[: -1 if r.text.endswith("\n\n") else None]]
        runs, found = read(in_memory(spark, lines))
        assert pairs_of(canonical.canonical_runs(runs), found) == want
    swapped = AlignMap.from_paf(spark, str(tmp_path / "x.paf"), swap=True, allow_overlap=True)
    assert pairs_of(swapped.runs, swapped.members) == {(t, q, s, b, a) for q, t, s, a, b in want}
    assert {r.name for r in m.member_by_rank("a", 0).collect()} == {"gA.chr1"}


def test_lift_against_base_pairs(spark, tmp_path):
    al = alignments(11, 25, False)
    want = set().union(*(x[-1] for x in al))
    runs, found = text.paf(in_memory(spark, map(paf_line, al)))
    runs = canonical.canonical_runs(runs)
    m = AlignMap(runs, found, found.select("axis", "group_id", "name").limit(0), None, None)
    rng = random.Random(3)
    w = [(k, "gA.chr1", lo := rng.randint(0, 890), lo + rng.choice([0, 1, 10, 200])) for k in range(40)]
    bed = spark.createDataFrame([(k, n, lo, hi, ["x", "0", "+", "rest"]) for k, n, lo, hi in [*w, (99, "nobody", 0, 5)]], "query_id long, name string, lo long, hi long, rest array<string>")
    lines, lost = m.lift_bed(bed)
    got = {}
    for r in lines.collect():
        name, s, e, _, _, strand, rest = r.text.split("\t")
        assert rest == "rest"
        got.setdefault(r.query_id, []).append((name, int(s), int(e), strand == "-"))
    for k, name, lo, hi in w:
        bases = {(t, b, s) for q, t, s, a, b in want if q == name and lo <= a < hi}
        assert {(t, b, s) for t, x, y, s in got.get(k, []) for b in range(x, y)} == bases
    assert {r.query_id for r in lost.collect()} == {99, *(k for k, n, lo, hi in w if k not in got)}
    from axismap.operators.lift import LiftOptions, lift, pieces

    iv = m.named(bed, "a").select("query_id", "member", "lo", "hi")
    flat = pieces(runs, iv).collect()
    for gap in (0, 5, 50):
        merged = lift(runs, iv, "a", LiftOptions(gap)).collect()
        groups = {}
        for p in sorted(flat, key=lambda p: (p.s0, p.t0, p.len)):
            opened = groups.setdefault((p.query_id, p.member, p.strand), [])
            for x in opened:
                across = x[0] - (p.t0 + p.len) if p.strand else p.t0 - x[1]
                if 0 <= p.s0 - x[3] <= gap and 0 <= across <= gap:
                    x[0], x[1], x[3], x[4] = min(x[0], p.t0), max(x[1], p.t0 + p.len), p.s0 + p.len, x[4] + p.len
                    break
            else:
                opened.append([p.t0, p.t0 + p.len, p.s0, p.s0 + p.len, p.len])
        assert sorted((q, t, s, *x) for (q, t, s), xs in groups.items() for x in xs) == sorted((r.query_id, r.member, r.strand, r.start, r.end, r.src_start, r.src_end, r.aligned_bp) for r in merged)
    single = spark.createDataFrame([(k, 0, k, k + 1) for k in range(0, 900, 13)], "query_id long, member long, lo long, hi long")
    best = m.lift(single, best=0.0).groupBy("query_id").count().filter("count > 1")
    assert best.count() == 0  # one base keeps one copy


BAD_PAF = ["a\t10\t0\t5\t+\tb\t10\t0\t5\t0\t0\t255\tcg:Z:4M", "a\t10\t0\t5\t+\tb\t10\t0\t5\t0\t0\t255", "a\t10\t0\t5\t+\tb\t10\t0\t5", "a\t10\t0\t5\t*\tb\t10\t0\t5\t0\t0\t255\tcg:Z:5M", "a\t10\t0\t15\t+\tb\t10\t0\t5\t0\t0\t255\tcg:Z:5M", "a\t10\t0\t5\t+\tb\t10\t0\t5\t0\t0\t255\tcg:Z:5S"]
BAD_CHAIN = [["3"], ["chain 1 a 10 + 0 5 b 10 + 0 5 1", "4"], ["chain 1 a 10 + 0 5 b 10 + 0 5 1", "3 1 1"], ["chain 1 a 10 + 0 5 b 10 + 0 5 1", "3 -1 -1", "3"], ["chain 1 a 10 + 0 5 b 10 + 0 5 1", "3 1 1", "", "1"], ["chain 1 a 10 + 0 5"], ["chain 1 a 10 + 0 5 b 10 * 0 5 1", "5"]]


@pytest.mark.parametrize("line", BAD_PAF)
def test_malformed_paf(spark, line):
    with pytest.raises(MapError):
        text.paf(in_memory(spark, [line]))


def test_one_name_with_two_lengths(spark):
    with pytest.raises(MapError, match="two lengths"):
        text.paf(in_memory(spark, [f"a\t{n}\t0\t5\t+\tb\t10\t0\t5\t0\t0\t255\tcg:Z:5M" for n in (10, 11)]))


def test_zero_length_operations_are_skipped(spark):
    runs, _ = text.paf(in_memory(spark, ["a\t10\t0\t5\t+\tb\t10\t0\t5\t0\t0\t255\tcg:Z:0S5M0I"]))
    assert [(r.a, r.b, r.len) for r in runs.collect()] == [(0, 0, 5)]


@pytest.mark.parametrize("lines", BAD_CHAIN)
def test_malformed_chain(spark, lines):
    with pytest.raises(MapError):
        text.ucsc_chain(in_memory(spark, lines))


def test_bed_reading(spark, tmp_path):
    (tmp_path / "x.bed").write_text("track x\nbrowser y\n# c\n\nn\t1\t5\tname\t0\t-\nm\t2\t2\n")
    got = text.bed(text.lines(spark, str(tmp_path / "x.bed"))).orderBy("query_id").collect()
    assert [(r.name, r.lo, r.hi, r.rest) for r in got] == [("n", 1, 5, ["name", "0", "-"]), ("m", 2, 2, [])]
    with pytest.raises(MapError):
        text.bed(in_memory(spark, ["n\t5\t1"]))
