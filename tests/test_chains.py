"""Chaining against a plain dynamic program, and the cut of spans into segments."""

from __future__ import annotations

import random

import pytest
from axismap.operators import chain, lift


def plain(spans, p):
    """Best predecessors by looking at all earlier spans, and greedy claims."""
    n = len(spans)
    best, prev = [x[4] for x in spans], [-1] * n
    for i, (qs, _, ts, _, own) in enumerate(spans):
        found = None
        for j, (qs2, qe, ts2, te, _) in enumerate(spans[:i]):
            qg, tg = qs - qe, ts - te
            if not (0 <= qg <= p.max_gap and 0 <= tg <= p.max_gap):
                continue
            cost = p.open + p.extend * (qg + tg) if qg + tg else 0
            if cost < own and best[j] > cost:
                key = (own + best[j] - cost, te, qe, qs2, ts2, j)
                found = max(found or key, key)
        if found:
            best[i], prev[i] = found[0], found[-1]
    root, score = [-1] * n, [0] * n
    for r in sorted(range(n), key=lambda i: (-best[i], -spans[i][0], -spans[i][2], -spans[i][1], -spans[i][3], -i)):
        if root[r] >= 0:
            continue
        at, total = r, best[r]
        while at >= 0 and root[at] < 0:
            root[at] = r
            last, at = at, prev[at]
        if at >= 0:
            total -= best[last] - spans[last][4]
        score[r] = total
    return [(r, score[r], best[r]) for r in root]


@pytest.mark.parametrize("p", [chain.ChainParams(), chain.ChainParams(0, 1, 40), chain.ChainParams(5, 2, 60), chain.ChainParams(3, 0, 25), chain.ChainParams(50, 1, 1000)])
def test_solve_is_the_plain_program(p):
    rng = random.Random(p.open + p.max_gap)
    for _ in range(60):
        spans = []
        for _ in range(rng.randint(1, 40)):
            q, t, n = rng.randint(0, 300), rng.randint(0, 300), rng.randint(1, 30)
            spans.append((q, q + n, t, t + n, n if p.open < 20 else n * 8))
        spans.sort(key=lambda x: (x[0], x[2], x[3], x[1]))
        assert chain.solve(spans, p) == plain(spans, p)


def test_long_sweeps_drop_what_is_out_of_reach():
    rng = random.Random(3)
    spans = sorted((q, q + 10, q // 2 + rng.randint(0, 3), q // 2 + 12, 10) for q in rng.sample(range(20_000), 1500))
    spans.sort(key=lambda x: (x[0], x[2], x[3], x[1]))
    p = chain.ChainParams(0, 1, 100)
    assert chain.solve(spans, p) == plain(spans, p)


@pytest.mark.parametrize("bin_width", [64, 1 << 20])
def test_segments_do_not_change_chains(spark, bin_width):
    rng = random.Random(8)
    rows = []
    for k in range(400):
        q, t, n = rng.randint(0, 4000), rng.randint(0, 4000), rng.randint(1, 60)
        rows.append((k % 2, k % 3, q, q + n, t, t + n, k % 2, n, k))
    df = spark.createDataFrame(rows, "q_member long, t_member long, q_start long, q_end long, t_start long, t_end long, strand int, score long, idx long")
    p = chain.ChainParams(0, 1, 50)
    cut = chain.segments(df, p, bin_width).collect()
    assert len({(r.q_member, r.strand, r.t_member, r.seg) for r in cut}) > 10
    got = {r.idx: (r.chain_id, r.chain_score) for r in chain.chain(df, p).collect()}
    chains = {}
    for key in {(r[0], r[6], r[1]) for r in rows}:
        own = [((-r[3], -r[2]) if r[6] else (r[2], r[3])) + (r[4], r[5], r[7], r[8]) for r in rows if (r[0], r[6], r[1]) == key]
        own.sort(key=lambda x: (x[0], x[2], x[3], x[1], x[5]))
        for x, (root, score, _) in zip(own, plain([x[:5] for x in own], p), strict=True):
            chains.setdefault(own[root][5], []).append(x[5])
            if own[root] is x:
                assert got[x[5]][1] == score
    members = {}
    for k, (number, _) in got.items():
        members.setdefault(number, set()).add(k)
    assert sorted(map(sorted, members.values())) == sorted(map(sorted, chains.values()))


def test_best_pieces_keep_the_better_of_two_copies():
    pieces = [(0, 0, 0, 1000, 100), (1, 0, 20, 5000, 60), (0, 0, 120, 1120, 100)]
    assert chain.best_pieces(pieces, chain.ChainParams(), 0.0) == [True, False, True]
    assert chain.best_pieces(pieces, chain.ChainParams(), 1.0) == [True] * 3 and lift.LiftOptions().overlap_frac < 0
