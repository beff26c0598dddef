"""Near copies by the exact Jaccard similarity of their 5-word shingles.

Two texts are linked if their sets of distinct shingles of ``SHINGLE`` words have a
similarity of ``SIMILAR`` (4/5) or more; one document of each component of links stays.
Candidates are first the links of ``simhash``: texts of equal fingerprints, and forests of
the pairs within ``RADIUS`` bits. At 0.8 most pairs differ in more bits, so further ones are
texts that agree in one of ``BANDS`` bands of ``ROWS`` minimum hashes: a
pair at similarity s is one of these with probability 1 - (1 - s^8)^50, 0.9999 at 0.8 and more
above, 0.06 where two texts share a passage of three fifths of each. Every link is verified on the whole sets, so only missed candidates can differ
from comparing all pairs.

Texts with equal sets are one node. Candidates are tried in passes, of which the later
ones only take pairs whose components still differ: those of the fingerprints, each node
with the least nodes of its bands (one, then seven more, then all of them), each node with
a node of another component drawn in each band, then all pairs that share a band. Before
the last two passes a node goes that cannot be similar to any of another component: its
shingles that other components have bound what it can share, and so the size of what it
can be similar to (``_bounded``). Pairs of the last pass are told apart by parities of their
shingles (``sketch``) inside the join, which bound the shingles that only one of two sets
has, before they become rows. All of these bounds are exact and nothing is capped. So a large
group of near copies costs pairs in proportion to its size; nodes that no bound tells from a
group without a link to it are still compared by their parities with all of it that shares a band.

Defined results: words as in ``simhash`` (A-Z lowered, ASCII white space); fewer than
five words are one shingle; null, empty and blank texts are copies of each other; of a
component stays the row with the least id (then the least hash of the text), one without
an id only if no row has one; repeated rows stay once; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axismap.llm import simhash
from axismap.llm.simhash import connect
from axismap.llm.tables import IDENTITY, kept_for, mark, release, slices, stash, stay

SHINGLE = 5
SIMILAR = (4, 5)
BANDS = 50
ROWS = 8
HUBS = (1, 8, BANDS)  # how many of a node's hubs have been tried after each pass
WORDS = 8  # 64-bit words of a sketch, a power of two
SKETCH = [f"w{k}" for k in range(WORDS)]
SEED = 42
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a whole text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    last = min(SHINGLE, len(words)) - 1
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.array([hashed(joined[starts[i] : ends[i + last] - 1], SEED) for i in range(max(1, len(words) - SHINGLE + 1))], np.uint64))


def node(of: np.ndarray) -> int:
    """What names a set of shingles."""
    return xxhash.xxh64_intdigest(of.tobytes(), SEED)


def bands(of: np.ndarray) -> bytes:
    """The BANDS values of a set (eight bytes each), two sets agreeing in each with probability s^ROWS."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(of), 1024):
        np.minimum(low, (_FACTORS * of[at : at + 1024]).min(1), out=low)
    raw = low.tobytes()
    return b"".join(xxhash.xxh64_digest(raw[8 * ROWS * k : 8 * ROWS * (k + 1)], k) for k in range(BANDS))


def sketch(of: np.ndarray) -> np.ndarray:
    """By 64 * WORDS classes of shingles, whether a set has an odd number of them (WORDS integers).

    Where two sets differ there, one of them has a shingle of the class that the other has not;
    so their sketches differ in no more bits than the sets in shingles.
    """
    classes = 64 * WORDS
    odd = np.bincount(((of * _FACTORS[0]) >> np.uint64(65 - classes.bit_length())).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _same(text: str):
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def marks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, same, node, n, bands, fp) of every row; ``same`` tells texts of one id apart. No shuffle."""
    slim = docs.select(F.col(f"`{key}`").alias("key"), _same(text).alias("same"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        kept_for("nearcopies")
        for b in slices(batches):
            texts = b.column(2).to_pylist()
            found = [shingles(t) for t in texts]
            prints = np.array([simhash.fingerprint(t) for t in texts], np.uint64).view(np.int64)
            nodes = np.array([node(s) for s in found], np.uint64).view(np.int64)
            sizes = pa.array([len(s) for s in found], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes), sizes, pa.array([bands(s) for s in found], pa.binary()), pa.array(prints)], ["key", "same", "node", "n", "bands", "fp"])

    return slim.mapInArrow(run, f"key {slim.schema['key'].dataType.simpleString()}, same bigint, node bigint, n int, bands binary, fp bigint")


def _banded(unique: DataFrame) -> DataFrame:
    """(band, node, n): a row per band of a node."""

    def run(batches):
        for b in slices(batches):
            values = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int64)
            at = pa.array(np.repeat(np.arange(b.num_rows), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(values), b.column(0).take(at), b.column(1).take(at)], ["band", "node", "n"])

    return unique.select("node", "n", "bands").mapInArrow(run, "band bigint, node bigint, n int")


def _sets(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(node, of, w0 to w7): the sets of the wanted nodes (node, key, same) with their sketches, each from one document."""
    slim = docs.select(F.col(f"`{key}`").alias("key"), _same(text).alias("same"), F.col(f"`{text}`").alias("text"))
    chosen = slim.join(wanted.select(F.col("key").alias("k"), F.col("same").alias("s")), F.col("key").eqNullSafe(F.col("k")) & (F.col("same") == F.col("s")), "left_semi").select("text")

    def run(batches):
        for b in slices(batches):
            found = [shingles(t) for t in b.column(0).to_pylist()]
            bits = np.array([sketch(s) for s in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.array([node(s) for s in found], np.uint64).view(np.int64)), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())), *(pa.array(bits[:, k].copy()) for k in range(WORDS))], ["node", *columns])

    columns = ["of", *SKETCH]
    return chosen.mapInArrow(run, "node bigint, of array<bigint>" + "".join(f", {w} bigint" for w in SKETCH)).groupBy("node").agg(*[F.first(c).alias(c) for c in columns])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) that are similar, with all of their shingles compared."""
    left, right = sets.select(F.col("node").alias("u"), F.col("of").alias("a")), sets.select(F.col("node").alias("v"), F.col("of").alias("b"))
    met = pairs.join(left, "u").join(right, "v").select("u", "v", (F.size("a") + F.size("b")).alias("n"), F.size(F.array_intersect("a", "b")).alias("shared"))
    return met.filter(SIMILAR[1] * F.col("shared") >= SIMILAR[0] * (F.col("n") - F.col("shared"))).select("u", "v")


def _fingerprinted(unique: DataFrame) -> DataFrame:
    """Candidates (u, v) by SimHash: nodes of one fingerprint with the least of them, and these along the links of fingerprints."""
    of = stash(unique.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("c")), "near-prints")
    links = stash(simhash.links(of.select("fp"), of.count()).distinct(), "near-linked")
    same = unique.join(of.filter("c > 1"), "fp").select(F.col("least").alias("u"), F.col("node").alias("v"))
    named = of.select("fp", "least")
    across = links.join(named.select(F.col("fp").alias("u"), F.col("least").alias("x")), "u").join(named.select(F.col("fp").alias("v"), F.col("least").alias("y")), "v")
    both = same.union(across.select(F.least("x", "y"), F.greatest("x", "y"))).filter("u != v").distinct()
    return stash(both, "near-pairs")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (u, v) whose components differ."""
    named = roots.select(F.col("u").alias("w"), "root")
    met = pairs.join(named.select(F.col("w").alias("u"), F.col("root").alias("ru")), "u", "left").join(named.select(F.col("w").alias("v"), F.col("root").alias("rv")), "v", "left")
    return met.filter("coalesce(ru, u) != coalesce(rv, v)").select("u", "v")


def _rooted(banded: DataFrame, roots: DataFrame) -> DataFrame:
    """``banded`` with the component of each node, of bands that several components share."""
    members = stash(banded.join(roots.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node")), "near-members")
    mixed = members.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("band")
    return stash(members.join(mixed, "band", "left_semi"), "near-mixed")


def _alike(a: str, b: str) -> str:
    """Sets of too different sizes cannot be similar."""
    return f"{SIMILAR[1]}L * least({a}, {b}) >= {SIMILAR[0]}L * greatest({a}, {b})"


def _two(members: DataFrame, by: Column) -> DataFrame:
    """(band, one, two): the first node of a band by ``by``, and the first one of another component.

    Written between the steps, so that the joins on a band stay open to the adaptive skew join.
    """
    each = members.groupBy("band", "root").agg(F.min(F.struct(by.alias("by"), "node", "n", "reach", "root")).alias("two"))
    each = stash(each, "near-firsts")
    first = stash(each.groupBy("band").agg(F.min("two").alias("one")), "near-first")
    others = stash(each.join(first, "band").filter("one.root != two.root"), "near-others")
    return stash(others.groupBy("band").agg(F.min("one").alias("one"), F.min("two").alias("two")), "near-two")


def _bounded(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(band, node, n, root, reach): ``members`` that can be similar to one of another component in their band.

    ``reach`` is the largest set to which a node can be similar that shares no more with it
    than the shingles that other components of the members have.
    """
    less, more = SIMILAR
    held = members.select("node", "root").distinct().join(sets, "node").select("node", "root", F.explode("of").alias("x"))
    common = held.groupBy("x").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("x")
    shared = held.join(common, "x").groupBy("node").agg(F.count("*").alias("c"))
    known = members.select("band", "node", "n", "root").join(shared, "node").withColumn("reach", F.floor((more + less) * F.col("c") / less) - F.col("n")).drop("c")
    known = stash(known.filter(f"{more}L * reach >= {less}L * n"), "near-known")
    least = _two(known, F.col("n"))
    return stash(known.join(least, "band").filter("if(root = one.root, two.n, one.n) <= reach").drop("one", "two"), "near-bounded")


def _drawn(members: DataFrame) -> DataFrame:
    """Candidates (u, v): each node of a band with one node of another component, the same for many."""
    met = members.join(_two(members, F.xxhash64("band", "node")), "band").withColumn("hub", F.expr("if(root = one.root, two, one)"))
    fit = met.filter(_alike("n", "hub.n") + " and n <= hub.reach and hub.n <= reach")
    return fit.select(F.least("node", "hub.node").alias("u"), F.greatest("node", "hub.node").alias("v")).distinct()


def _rest(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidates (u, v): all pairs of a band in different components that no bound tells apart.

    The largest component of a band stands on one side only, so its nodes do not meet each other.
    """
    less, more = SIMILAR
    largest = members.groupBy("band", "root").agg(F.count("*").alias("c")).groupBy("band").agg(F.max(F.struct("c", "root")).alias("most")).select("band", F.col("most.root").alias("top"))
    every = members.join(stash(largest, "near-largest"), "band").join(sets.select("node", *SKETCH), "node")
    one, two = every.filter("root != top").alias("x"), every.alias("y")
    apart = " + ".join(f"bit_count(x.{w} ^ y.{w})" for w in SKETCH)
    fit = f"x.band = y.band and x.root != y.root and (y.root = y.top or x.node < y.node) and x.n <= y.reach and y.n <= x.reach and {_alike('x.n', 'y.n')}"
    met = one.join(two, F.expr(f"{fit} and {more + less}L * ({apart}) <= {more - less}L * (x.n + y.n)"))
    return met.select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v")).distinct()


def linked(docs: DataFrame, unique: DataFrame, key: str, text: str) -> DataFrame:
    """(u, root): components of the nodes in ``unique``; a root has no row of its own."""
    spark, since = docs.sparkSession, mark(docs.sparkSession)
    every = stash(_banded(unique), "near-bands")
    shared = every.groupBy("band").agg(F.min("node").alias("hub"), F.min_by("n", "node").alias("hub_n"), F.count("*").alias("c")).filter("c > 1").drop("c")
    banded = stash(every.join(shared, "band"), "near-shared")
    release(spark, since, [banded])
    first = _fingerprinted(unique)
    release(spark, since, [banded, first])
    nodes = banded.select("node").union(first.select("u")).union(first.select("v")).distinct()
    sets = stash(_sets(docs, unique.join(nodes, "node", "left_semi").select("node", "best.key", "best.same"), key, text), "near-sets")
    hubs = banded.filter("hub < node and " + _alike("n", "hub_n")).select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    stars = stash(hubs.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("u"))), "near-stars")
    edges = stash(_verified(first, sets), "near-links")
    roots = stash(connect(edges), "near-roots")
    for since_, upto in zip((0, *HUBS), HUBS, strict=False):
        pairs = stash(_apart(stars.filter(f"nth > {since_} and nth <= {upto}"), roots), "near-pairs")
        edges = stash(edges.union(_verified(pairs, sets)), "near-links")
        roots = stash(connect(edges), "near-roots")
        release(spark, since, [banded, sets, edges, roots, stars])
    members = _bounded(_rooted(banded.select("band", "node", "n"), roots), sets)
    release(spark, since, [sets, edges, members])
    edges = stash(edges.union(_verified(stash(_drawn(members), "near-pairs"), sets)), "near-links")
    roots = stash(connect(edges), "near-roots")
    members = _bounded(_rooted(members.select("band", "node", "n"), roots), sets)
    release(spark, since, [sets, edges, members])
    edges = stash(edges.union(_verified(stash(_rest(members, sets), "near-pairs"), sets)), "near-links")
    release(spark, since, [edges])
    return connect(edges)


def near_copies_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component of near copies: that with the least id."""
    marked = stash(marks(docs, key, text), "near-marks")
    best = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "same")).alias("best")
    unique = stash(marked.groupBy("node").agg(best, F.first("n").alias("n"), F.first("bands").alias("bands"), F.min("fp").alias("fp")), "near-nodes")
    since = mark(docs.sparkSession)
    roots = stash(linked(docs, unique, key, text), "near-roots")
    release(docs.sparkSession, since, [roots])
    named = unique.select("node", "best").join(roots, unique["node"] == roots["u"], "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    kept = named.select(F.col("best.none").alias("none"), F.coalesce(F.col("best.key").cast("string"), F.lit("")).alias("id"), F.col("best.same").alias("same"), F.lit(True).alias("kept"))
    per = marked.groupBy(F.col("key").isNull().alias("none"), F.coalesce(F.col("key").cast("string"), F.lit("")).alias("id"), "same").agg(F.count("*").alias("n"))
    fates = per.join(kept, IDENTITY, "left").filter("kept is null or n > 1").select(*IDENTITY, F.col("kept").isNull().alias("gone"))
    return stay(docs, stash(fates, "near-fates"), key, text)
