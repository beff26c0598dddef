"""Chaining of collinear spans, and the choice of best copies along the query.

A span joins query [q_start, q_end) to target [t_start, t_end) with a score. Chains
are the best-scoring collinear sequences: a gap costs ``open + extend * (query gap +
target gap)``, neither gap over ``max_gap``. A link must cost less than the later span
scores, so no gap exceeds what the best score of any span allows. Spans of one (q_member,
strand, t_member) are cut where the query gap to all before is larger, bin by bin, and every
segment is solved on its own; within it, predecessors are looked up by where they end on the
target, as far back as the later span's score reaches.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axismap.operators.ordered import islands, numbered
from axismap.operators.streams import ordered_fold

BIN = 1 << 20
SPAN_COLUMNS = ["q_member", "t_member", "q_start", "q_end", "t_start", "t_end", "strand", "score"]


@dataclass(frozen=True)
class ChainParams:
    open: int = 0
    extend: int = 1
    max_gap: int = 10_000_000


def solve(spans: list[tuple[int, int, int, int, int]], p: ChainParams) -> list[tuple[int, int, int]]:
    """Chains of one segment, in the order of claiming.

    ``spans`` are (qs, qe, ts, te, score) in sweep order (qs, ts, te, qe, input), with
    reverse queries already mirrored. Returns for each span (root, score, full): the
    number of the span that heads its chain, the chain's score, and its score before
    links that another chain had claimed were cut off.
    """
    n = len(spans)
    if n == 1:
        return [(0, spans[0][4], spans[0][4])]
    best, prev = [x[4] for x in spans], [-1] * n
    reach = [_reach(x[4], p) for x in spans]
    furthest = max(reach)
    # spans that a later one may reach, by where they end on the target; of equally good ones the last is taken
    live: list[tuple[int, int, int, int, int]] = []
    added = 0
    for i, (qs, qe, ts, te, own) in enumerate(spans):
        if added > len(live) // 2 + 32:
            live = [x for x in live if x[1] >= qs - furthest]
            added = 0
        limit, top = reach[i], own
        for k in range(bisect_left(live, (ts - limit,)), len(live)):
            e, f, _, _, j = live[k]
            if e > ts:
                break
            qg = qs - f
            if qg < 0 or qg > limit:
                continue
            gap = qg + ts - e
            cost = p.open + p.extend * gap if gap else 0
            if cost < own and (total := own + best[j] - cost) > own and total >= top:
                top, prev[i] = total, j
        best[i] = top
        insort(live, (te, qe, qs, ts, i))
        added += 1

    root, score = [-1] * n, [0] * n
    claims = sorted(range(n), key=lambda i: (-best[i], -spans[i][0], -spans[i][2], -spans[i][1], -spans[i][3], -i))
    for r in claims:
        if root[r] >= 0:
            continue
        at = r
        while True:
            root[at] = r
            before = prev[at]
            if before < 0 or root[before] >= 0:
                break
            at = before
        score[r] = best[r] - best[at] + spans[at][4]  # what stood before the last span is another chain's
    return [(r, score[r], best[r]) for r in root]


def _reach(own: int, p: ChainParams) -> int:
    """The largest gap that a span of this score can be linked over."""
    if own <= p.open:
        return 0
    return min(p.max_gap, (own - p.open - 1) // p.extend) if p.extend > 0 else p.max_gap


def segments(spans: DataFrame, p: ChainParams, bin_width: int = BIN) -> DataFrame:
    """Spans with qs, qe (mirrored on strand 1) and seg: where their segment starts on the query."""
    rev = F.col("strand") == 1
    s = spans.withColumn("qs", F.when(rev, -F.col("q_end")).otherwise(F.col("q_start"))).withColumn("qe", F.when(rev, -F.col("q_start")).otherwise(F.col("q_end")))
    s = s.withColumn("bin", F.floor(F.col("qs") / bin_width))
    keys, order = ["q_member", "strand", "t_member"], ["qs", "t_start", "t_end", "qe", "idx"]
    far = F.lit(p.max_gap)
    if p.extend > 0:  # one row: the best score of any span bounds every gap
        s = s.crossJoin(F.broadcast(spans.agg(F.max("score").alias("__top"))))
        far = F.greatest(F.lit(0), F.least(far, F.floor((F.col("__top") - p.open - 1) / p.extend)))
    return islands(s, keys, "bin", order, F.col("qs"), F.col("qe") + far, "seg").drop("__top", "bin")


def chain(spans: DataFrame, params: ChainParams = ChainParams(), idx: str = "idx") -> DataFrame:
    """``spans`` (SPAN_COLUMNS and ``idx``, their input order) with chain_id and chain_score.

    Ids count from 1 over (q_member, reverse strand first), by root score; they don't
    depend on the input order, except among identical spans.
    """
    s = segments(spans.select(*SPAN_COLUMNS, F.col(idx).alias("idx")), params)
    keys = ["q_member", "strand", "t_member", "seg"]
    columns = [*keys, "qs", "qe", "t_start", "t_end", "score", "idx"]

    def fold(rows):
        for key, group in groupby(rows, key=lambda r: r[:4]):
            g = list(group)
            solved = solve([(r[4], r[5], r[6], r[7], r[8]) for r in g], params)
            for r, (root, score, full) in zip(g, solved, strict=True):
                h = g[root]
                yield (key[0], key[1], r[9], full, h[4], h[6], h[5], h[7], key[2], h[9], score)

    schema = "q_member bigint, strand int, idx bigint, full bigint, r_qs bigint, r_ts bigint, r_qe bigint, r_te bigint, r_t bigint, r_idx bigint, chain_score bigint"
    out = ordered_fold(s, keys, ["qs", "t_start", "t_end", "qe", "idx"], columns, fold, schema)
    roots = out.filter("idx = r_idx").withColumn("rev", -F.col("strand"))
    order = [F.desc(c) for c in ("full", "r_qs", "r_ts", "r_qe", "r_te", "r_t", "r_idx")]
    ids = numbered(roots, ["q_member", "rev"], order, "chain_id", bin_=-F.floor(F.log2(F.greatest(F.col("full"), F.lit(1))))).select(F.col("r_idx").alias("root"), "chain_id")
    marked = out.join(ids, out["r_idx"] == ids["root"]).select("idx", F.col("chain_id").cast("bigint"), "chain_score")
    return spans.join(marked, spans[idx] == marked["idx"]).select(*[spans[c] for c in spans.columns], "chain_id", "chain_score")


def chain_infos(chained: DataFrame) -> DataFrame:
    """Per chain: chain_id, score, bp (query bases), n_spans; best first."""
    infos = chained.groupBy("chain_id").agg(F.max("chain_score").alias("score"), F.sum(F.col("q_end") - F.col("q_start")).alias("bp"), F.count("*").alias("n_spans"))
    return infos.orderBy(F.desc("score"), "chain_id")


def pick(chains: list[tuple[int, int, list[tuple[int, int]]]], overlap_frac: float, cap: int = 0) -> set[int]:
    """Ids of chains (id, score, query intervals) kept best-first.

    One is dropped if what it covers overlaps the kept cover by more than
    ``overlap_frac`` of itself; ``cap`` over 0 ends after so many.
    """
    kept: set[int] = set()
    cover = Cover()
    for number, _, parts in sorted(chains, key=lambda c: (-c[1], c[0])):
        own = union(parts)
        if cover.shares(own, overlap_frac * sum(e - s for s, e in own)):
            continue
        kept.add(number)
        for s, e in own:
            cover.add(s, e)
        if cap and len(kept) >= cap:
            break
    return kept


class Cover:
    """Disjoint intervals in order, found by bisection; abutting ones merge."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def shares(self, parts: list[tuple[int, int]], most: float) -> bool:
        """Whether disjoint ``parts`` have more than ``most`` bases in common with the cover."""
        total = 0
        for s, e in parts:
            k = bisect_right(self.ends, s)
            while k < len(self.starts) and self.starts[k] < e:
                total += min(e, self.ends[k]) - max(s, self.starts[k])
                if total > most:
                    return True
                k += 1
        return total > most

    def add(self, s: int, e: int) -> None:
        i, j = bisect_left(self.ends, s), bisect_right(self.starts, e)
        if i < j:
            s, e = min(s, self.starts[i]), max(e, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [s], [e]


def union(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint intervals with the same cover; abutting ones merge."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(parts):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def select_chains(chained: DataFrame, overlap_frac: float, cap: int = 0, by: str = "q_member") -> DataFrame:
    """``chain_id`` and ``keep`` of chains, chosen best-first within each value of ``by``.

    Without ``cap`` chains whose extents on the query do not meet, even by way of others, are
    chosen apart from each other: a task holds one such stretch, not a whole query.
    """
    slim = chained.select(F.col(by).cast("bigint").alias("by"), "chain_id", "chain_score", "q_start", "q_end")
    if cap:
        slim = slim.withColumn("part", F.lit(0).cast("bigint"))
    else:
        extents = slim.groupBy("by", "chain_id").agg(F.min("q_start").alias("s"), F.max("q_end").alias("e")).withColumn("bin", F.floor(F.col("s") / BIN))
        parts = islands(extents, ["by"], "bin", ["s", "e"], F.col("s"), F.col("e"), "part").select("by", "chain_id", "part")
        slim = slim.join(parts, ["by", "chain_id"])

    def fold(rows):
        for (key, _), group in groupby(rows, key=lambda r: r[:2]):
            chains: dict[int, tuple[int, int, list]] = {}
            for _, _, number, score, s, e in group:
                chains.setdefault(number, (number, score, []))[2].append((s, e))
            kept = pick(list(chains.values()), overlap_frac, cap)
            for number in chains:
                yield key, number, number in kept

    return ordered_fold(slim, ["by", "part"], ["chain_id"], ["by", "part", "chain_id", "chain_score", "q_start", "q_end"], fold, "by bigint, chain_id bigint, keep boolean").select("chain_id", "keep")


def best_pieces(pieces: list[tuple[int, int, int, int, int]], params: ChainParams, overlap_frac: float) -> list[bool]:
    """Which pieces (t_member, strand, s0, t0, len) of one query belong to kept chains.

    Query is the source axis; ids follow (reverse strand first, root score, ...), as in ``chain``.
    """
    if len(pieces) <= 1:
        return [True] * len(pieces)
    keyed = []
    for k, (t, strand, s0, t0, n) in enumerate(pieces):
        qs, qe = (-(s0 + n), -s0) if strand else (s0, s0 + n)
        keyed.append((-strand, t, qs, t0, t0 + n, qe, k))
    keyed.sort()
    roots: list[tuple] = []
    of_piece: dict[int, int] = {}
    score_of: dict[int, int] = {}
    for (rev, t), group in groupby(keyed, key=lambda x: x[:2]):
        g = list(group)
        for x, (root, score, full) in zip(g, solve([(y[2], y[5], y[3], y[4], y[5] - y[2]) for y in g], params), strict=True):
            h = g[root]
            of_piece[x[6]] = h[6]
            if x is h:
                roots.append((rev, -full, -h[2], -h[3], -h[5], -h[4], -t, -h[6], h[6]))
                score_of[h[6]] = score
    number = {r[-1]: k for k, r in enumerate(sorted(roots))}
    parts: dict[int, list] = {}
    for k, (_, _, s0, _, n) in enumerate(pieces):
        parts.setdefault(of_piece[k], []).append((s0, s0 + n))
    kept = pick([(number[r], score_of[r], p) for r, p in parts.items()], overlap_frac)
    return [number[of_piece[k]] in kept for k in range(len(pieces))]
