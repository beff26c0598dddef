"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits from the XXH64 hashes of a text's 4-word shingles. The
bits are grouped, correlated ones together, into partitions: four of 16 bits, or three
of 21 or 22 beyond ``WIDER`` distinct fingerprints, so that a partition value stands for
few of them; both find the same links. For a
pair at distance ``d <= radius`` and thresholds t_i >= -1 with sum(t_i + 1) =
radius + 1, some partition of the pair differs in at most t_i bits. Each
fingerprint picks its own thresholds by dynamic programming over estimated
candidate counts (exact histograms of the partition values, summed over Hamming
balls), probes the values within t_i of its own, and every candidate is verified
on all 64 bits.

Equal fingerprints are one node, so copies cost one row each. A value's candidates
are checked in cells of at most ``CELL`` by ``CELL`` fingerprints; a larger value
becomes a grid of cells on several tasks, so nothing is capped. A task returns a
spanning forest of the links that it found, never all pairs. Components come from
alternating large-star and small-star rounds over those forests, each round a
written table; joins on a hub can be split by the adaptive skew join. The driver
gets bit pair counts (2,080 rows) and the histograms (at most 4 x 65,536 rows, or 2^23).

Defined results: a null, empty or blank text has fingerprint zero and links like
any other; fewer than four words are one shingle; ties of the half (as many ones
as zeros) give 0; a null id never names a component unless all of its ids are
null; repeated rows stay repeated; empty tables give empty results; other columns
are ignored by ``components`` and pass through ``near_dedup``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axismap.llm.tables import IDENTITY, identity, mark, release, slices, stash, stay

SHINGLE = 4
SEED = 42
BITS = 64
RADIUS = 4
PARTS, WIDER = 4, 1 << 27
MAX_THRESHOLD = 2
CELL = 4096
PROBE_COST = 4
PAIRS_AT_ONCE = 1 << 21
ROWS_PER_TASK = 1 << 20
_ROW = np.dtype([("code", "<u4"), ("cell", "<u4"), ("fp", "<u8"), ("role", "u1")])
INDEX, PROBE = 1, 2


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a whole text, shingles counted with repeats."""
    words = (text or "").encode().lower().split()  # bytes: lowers A-Z, splits at ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    n = max(1, len(words) - SHINGLE + 1)
    starts = [0, *ends]
    last = min(SHINGLE, len(words)) - 1
    hashed = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([hashed(joined[starts[i] : ends[i + last] - 1], SEED) for i in range(at, min(n, at + (1 << 16)))], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed 64-bit integer. No shuffle."""
    slim = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        for b in slices(batches):
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["key", "fp"])

    return slim.mapInArrow(run, f"key {slim.schema['key'].dataType.simpleString()}, fp bigint")


def _fps(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)


def bit_pairs(unique: DataFrame) -> np.ndarray:
    """How many fingerprints have both bit a and bit b (64 x 64), over all of them."""

    def run(batches):
        both = np.zeros((BITS, BITS), np.int64)
        for b in batches:
            bits = np.unpackbits(_fps(b).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            both += (bits.T @ bits).astype(np.int64)
        a, c = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(both[a, c])], ["a", "b", "n"])

    out = np.zeros((BITS, BITS), np.int64)
    for r in unique.select("fp").mapInArrow(run, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        out[r["a"], r["b"]] = out[r["b"], r["a"]] = r["n"]
    return out


def group_bits(both: np.ndarray, n: int, parts: int = PARTS) -> list[list[int]]:
    """Bits in ``parts`` partitions of near equal width, each grown by the bit most correlated with it."""
    p = both.diagonal() / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs(both / max(1, n) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(related, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        pool = sorted(left)
        a, b = max(combinations(pool, 2), key=lambda x: related[x])
        group = [a, b]
        while len(group) < -(-len(pool) // (parts - k)):
            rest = [x for x in pool if x not in group]
            group.append(max(rest, key=lambda x: related[x, group].sum()))
        left -= set(group)
        groups.append(sorted(group))
    return groups


def part_values(fp: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """The value of each partition of each fingerprint: n x partitions."""
    out = np.zeros((len(fp), len(groups)), np.uint32)
    for i, group in enumerate(groups):
        for j, bit in enumerate(group):
            out[:, i] |= (((fp >> np.uint64(bit)) & np.uint64(1)) << np.uint64(j)).astype(np.uint32)
    return out


def ball(radius: int, width: int) -> np.ndarray:
    """The masks of at most ``radius`` of ``width`` bits, nearest first."""
    return np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)], np.uint32)


def offsets(groups: list[list[int]]) -> np.ndarray:
    """Where the values of each partition start in the codes of all, and their number."""
    return np.cumsum([0, *(1 << len(g) for g in groups)])


def histograms(unique: DataFrame, groups: list[list[int]]) -> np.ndarray:
    """By code (partition and value), how many fingerprints have it, over all of them."""
    first = offsets(groups)

    def run(batches):
        counts = np.zeros(int(first[-1]), np.int64)
        for b in batches:
            v = part_values(_fps(b), groups)
            for i in range(len(groups)):
                counts[first[i] : first[i + 1]] += np.bincount(v[:, i], minlength=1 << len(groups[i]))
        code = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(counts[code])], ["code", "n"])

    found = unique.select("fp").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(int(first[-1]), np.int64)
    out[found.column("code").to_numpy()] = found.column("n").to_numpy()
    return out


def candidate_counts(hist: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """By threshold 0 to MAX_THRESHOLD and code: fingerprints within it."""
    first, out = offsets(groups), np.zeros((MAX_THRESHOLD + 1, len(hist)), np.int64)
    for i, group in enumerate(groups):
        own, values, total, done = hist[first[i] : first[i + 1]], np.arange(1 << len(group), dtype=np.uint32), 0, 0
        masks = ball(MAX_THRESHOLD, len(group))
        for t in range(MAX_THRESHOLD + 1):
            size = len(ball(t, len(group)))
            for m in masks[done:size]:
                total = total + own[values ^ m]
            out[t, first[i] : first[i + 1]], done = total, size
    return out


def allocate(codes: np.ndarray, counts: np.ndarray, radius: int, widths: list[int]) -> np.ndarray:
    """Thresholds (n x partitions, -1 and up) of least estimated cost; one more each, they sum to radius + 1."""
    n, units = len(codes), radius + 1
    best = np.full((n, units + 1), np.inf)
    best[:, 0] = 0
    picks = []
    for i, width in enumerate(widths):
        probes = [0, *(len(ball(r, width)) for r in range(MAX_THRESHOLD + 1))]
        grown, pick = np.full((n, units + 1), np.inf), np.zeros((n, units + 1), np.int8)
        for take in range(min(units, MAX_THRESHOLD + 1) + 1):
            cost = counts[take - 1, codes[:, i]] + PROBE_COST * probes[take] if take else np.zeros(n)
            for u in range(take, units + 1):
                total = best[:, u - take] + cost
                better = total < grown[:, u]
                grown[better, u], pick[better, u] = total[better], take
        best = grown
        picks.append(pick)
    out, at, row = np.zeros((n, len(widths)), np.int8), np.full(n, units), np.arange(n)
    for i in reversed(range(len(widths))):
        out[:, i] = picks[i][row, at] - 1
        at = at - picks[i][row, at]
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def signature_rows(fp: np.ndarray, groups: list[list[int]], hist: np.ndarray, counts: np.ndarray, radius: int) -> np.ndarray:
    """Index and probe rows of fingerprints; those of a large value for each cell of its grid."""
    first, widths = offsets(groups), [len(g) for g in groups]
    codes = part_values(fp, groups).astype(np.int64) + first[:-1]
    limits = allocate(codes, counts, radius, widths)
    mixed = _mix(fp)
    parts = []

    def put(code: np.ndarray, who: np.ndarray, role: int) -> None:
        across, down = -(-hist[code] // CELL), -(-counts[1, code] // CELL)
        across, down = np.maximum(across, 1), np.maximum(down, 1)
        own, other = (across, down) if role == INDEX else (down, across)
        mine = (mixed[who] % own.astype(np.uint64)).astype(np.int64)
        again = np.repeat(np.arange(len(code)), other)
        k = np.arange(len(again)) - np.repeat(np.cumsum(other) - other, other)
        rows = np.zeros(len(again), _ROW)
        rows["code"], rows["fp"], rows["role"] = code[again], fp[who][again], role
        a, b = (mine[again], k) if role == INDEX else (k, mine[again])
        rows["cell"] = a * down[again] + b
        parts.append(rows)

    every = np.arange(len(fp))
    for i, width in enumerate(widths):
        put(codes[:, i], every, INDEX)
        for t in range(MAX_THRESHOLD + 1):
            who = np.flatnonzero(limits[:, i] >= t)
            for m in ball(t, width)[len(ball(t - 1, width)) if t else 0 :].tolist():
                put(first[i] + ((codes[who, i] - first[i]) ^ m), who, PROBE)
    return np.concatenate(parts)


def forest(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> None:
    """Give every node of the links a-b (and of what ``label`` links) the least label."""
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]


def links_within(rows: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (fp, smaller fp) of the verified links among a task's rows."""
    rows = rows[np.lexsort((rows["role"], rows["cell"], rows["code"]))]
    nodes, at = np.unique(rows["fp"], return_inverse=True)
    label = np.arange(len(nodes))
    group = rows["code"].astype(np.uint64) << np.uint64(32) | rows["cell"].astype(np.uint64)
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(rows) else np.zeros(0, np.int64)
    is_index = rows["role"] == INDEX
    n_index = np.add.reduceat(is_index, cuts) if len(cuts) else cuts
    # every probe row meets the index rows of its cell, which stand first in it
    probe = np.flatnonzero(~is_index)
    cell = np.searchsorted(cuts, probe, side="right") - 1
    width = n_index[cell] if len(cuts) else probe
    upto = np.cumsum(width)
    start = 0
    while start < len(probe):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS_AT_ONCE, side="right")))
        w = width[start:end]
        left = np.repeat(probe[start:end], w)
        right = np.repeat(cuts[cell[start:end]], w) + np.arange(len(left)) - np.repeat(np.cumsum(w) - w, w)
        near = (np.bitwise_count(rows["fp"][left] ^ rows["fp"][right]) <= radius) & (at[left] != at[right])
        forest(at[left[near]], at[right[near]], label)
        start = end
    linked = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[linked], nodes[label[linked]]


def links(unique: DataFrame, n: int, radius: int = RADIUS, parts: int | None = None) -> DataFrame:
    """(u, v): links whose components are those of all pairs within ``radius``."""
    groups = group_bits(bit_pairs(unique), n, parts or (PARTS if n <= WIDER else PARTS - 1))
    hist = histograms(unique, groups)
    counts = candidate_counts(hist, groups)
    tasks = max(int(unique.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * 24 // ROWS_PER_TASK))
    shared = unique.sparkSession.sparkContext.broadcast((groups, hist, counts))

    def spread(batches):
        of, by_value, within = shared.value
        for b in batches:
            for k in range(0, b.num_rows, 20_000):
                rows = signature_rows(_fps(b.slice(k, 20_000)), of, by_value, within, radius)
                task = (_mix(rows["code"].astype(np.uint64) << np.uint64(32) | rows["cell"].astype(np.uint64)) % np.uint64(tasks)).astype(np.int64)
                order = np.argsort(task, kind="stable")
                found, first = np.unique(task[order], return_index=True)
                blobs = [x.tobytes() for x in np.split(rows[order], first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(blobs, pa.binary())], ["task", "rows"])

    def meet(table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x, _ROW) for x in table.column("rows").to_pylist()])
        u, v = links_within(rows, radius)
        return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    return unique.select("fp").mapInArrow(spread, "task bigint, rows binary").groupBy("task").applyInArrow(meet, "u bigint, v bigint")


def connect(edges: DataFrame) -> DataFrame:
    """(u, root): the least node of each node's component, from links (u, v).

    Large-star and small-star rounds; the number of rounds grows with the logarithm
    of the longest chain. A root has no row of its own. A round's tables go with the next.
    """
    spark = edges.sparkSession
    since = mark(spark)
    edges = stash(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.withColumnRenamed("v", "root")
        seen = now
        both = stash(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "links")
        least = stash(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "links")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = stash(large, "links")
        least = stash(large.groupBy("u").agg(F.min("v").alias("m")), "links")
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = stash(small.union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "links")
        release(spark, since, [edges])


def components(docs: DataFrame, radius: int = RADIUS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``docs``: key, fingerprint (hexadecimal), component_id."""
    marked = stash(fingerprints(docs, key, text), "simhash")
    unique = stash(marked.groupBy("fp").agg(F.min("key").alias("least")), "simhash-unique")
    roots = stash(connect(links(unique, unique.count(), radius)), "simhash-roots")
    rooted = stash(unique.join(roots, unique["fp"] == roots["u"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    named = stash(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-named")
    classes = stash(rooted.join(named, "root").select("fp", "component_id"), "simhash-classes")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(classes, "fp").select(F.col("key").alias(key), hexed.alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, radius: int = RADIUS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id (then the least hash of its text).

    A row without an id stays only if no row of its component has one.
    """
    _, _, same = identity(key, text)
    id_ = F.col(f"`{key}`")
    slim = docs.select(F.struct(id_.isNull().alias("none"), id_.alias("key"), same.alias("same")).alias("row"), F.col(f"`{text}`").alias("text"))
    found = stash(components(slim, radius, "row", "text"), "simhash-rows")
    per = found.groupBy("row").agg(F.count("*").alias("n"), F.first("component_id").alias("best"))
    per = per.select("row.none", F.coalesce(F.col("row.key").cast("string"), F.lit("")).alias("id"), "row.same", (F.col("row.key").eqNullSafe(F.col("best.key")) & (F.col("row.same") == F.col("best.same"))).alias("kept"), "n")
    fates = per.filter("not kept or n > 1").select(*IDENTITY, (~F.col("kept")).alias("gone"))
    return stay(docs, stash(fates, "simhash-fates"), key, text)
