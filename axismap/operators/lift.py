"""Lifting intervals through a map.

1. Pieces: the interval join, clipped, in source order.
2. Best copies (``overlap_frac`` >= 0): pieces of a query are chained, and those of
   chains that overlap better ones too much on the source are dropped.
3. Merge (``max_gap`` >= 0): a piece joins the first still-open result, in order of
   creation, of its target member and strand whose source and target gaps both lie in
   [0, max_gap]. Several results may be open at once, so this is a fold; a window cuts
   each (query, target member, strand) where the source gap to all before is too
   large, and pieces alone in their segment skip the fold.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axismap.operators.chain import ChainParams, best_pieces
from axismap.operators.query import query
from axismap.operators.streams import ordered_fold
from axismap.schema import other

LIFTED = ["query_id", "member", "start", "end", "strand", "src_start", "src_end", "aligned_bp"]


@dataclass(frozen=True)
class LiftOptions:
    max_gap: int = -1
    overlap_frac: float = -1.0
    chain: ChainParams = field(default_factory=ChainParams)


def pieces(runs: DataFrame, intervals: DataFrame, source: str = "a", width: int | None = None) -> DataFrame:
    """query_id, s0, member, t0, len, strand: the clipped runs under each interval."""
    far = other(source)
    return query(runs, intervals, source, width).select("query_id", F.col(source).alias("s0"), F.col(f"{far}_member").alias("member"), F.col(far).alias("t0"), "len", "strand")


def best(found: DataFrame, overlap_frac: float, params: ChainParams) -> DataFrame:
    """Pieces of kept chains only, query by query."""

    def fold(rows):
        for _, group in groupby(rows, key=lambda r: r[0]):
            g = list(group)
            for r, keep in zip(g, best_pieces([(r[2], r[5], r[1], r[3], r[4]) for r in g], params, overlap_frac), strict=True):
                if keep:
                    yield r

    columns = ["query_id", "s0", "member", "t0", "len", "strand"]
    return ordered_fold(found, ["query_id"], ["s0", "t0", "len", "strand", "member"], columns, fold, "query_id bigint, s0 bigint, member bigint, t0 bigint, len bigint, strand int")


def merge(found: DataFrame, max_gap: int) -> DataFrame:
    """Pieces merged over gaps of at most ``max_gap`` on both axes."""
    key = ["query_id", "member", "strand"]
    order = ["s0", "t0", "len"]
    by = Window.partitionBy(*key).orderBy(*order)
    reach = F.max(F.col("s0") + F.col("len")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    cut = found.withColumn("__reach", reach)
    cut = cut.withColumn("seg", F.sum((F.col("__reach").isNull() | (F.col("s0") - F.col("__reach") > max_gap)).cast("int")).over(by)).drop("__reach")
    cut = cut.withColumn("__n", F.count("*").over(Window.partitionBy(*key, "seg")))
    alone, several = cut.filter("__n = 1"), cut.filter("__n > 1").drop("__n")

    def fold(rows):
        for (q, m, strand, _), group in groupby(rows, key=lambda r: r[:4]):
            done: list[list[int]] = []  # start, end, src_start, src_end, aligned
            for _, _, _, _, s0, t0, n in group:
                for x in done:
                    across = x[0] - (t0 + n) if strand else t0 - x[1]
                    if 0 <= s0 - x[3] <= max_gap and 0 <= across <= max_gap:
                        if strand:
                            x[0] = t0
                        else:
                            x[1] = t0 + n
                        x[3] = s0 + n
                        x[4] += n
                        break
                else:
                    done.append([t0, t0 + n, s0, s0 + n, n])
            for x in done:
                yield q, m, x[0], x[1], strand, x[2], x[3], x[4]

    columns = [*key, "seg", *order]
    schema = "query_id bigint, member bigint, start bigint, end bigint, strand int, src_start bigint, src_end bigint, aligned_bp bigint"
    return ordered_fold(several, [*key, "seg"], order, columns, fold, schema, dealt=True).unionByName(as_results(alone))


def as_results(found: DataFrame) -> DataFrame:
    """Each piece as a result of its own."""
    return found.select("query_id", "member", F.col("t0").alias("start"), (F.col("t0") + F.col("len")).alias("end"), "strand", F.col("s0").alias("src_start"), (F.col("s0") + F.col("len")).alias("src_end"), F.col("len").alias("aligned_bp"))


def lift(runs: DataFrame, intervals: DataFrame, source: str = "a", options: LiftOptions = LiftOptions(), width: int | None = None) -> DataFrame:
    """Results (LIFTED columns) of intervals (query_id, member, lo, hi) on the ``source`` axis."""
    found = pieces(runs, intervals, source, width)
    if options.overlap_frac >= 0:
        found = best(found, options.overlap_frac, options.chain)
    if options.max_gap >= 0:
        return merge(found, options.max_gap)
    return as_results(found)


def min_match(lifted: DataFrame, intervals: DataFrame, fraction: float) -> DataFrame:
    """Results that align at least ``fraction`` of their interval; 0 keeps all."""
    if fraction <= 0:
        return lifted
    sizes = intervals.select("query_id", (F.col("hi") - F.col("lo")).alias("__size"))
    return lifted.join(sizes, "query_id").filter((F.col("__size") <= 0) | ~(F.col("aligned_bp") < F.lit(float(fraction)) * F.col("__size"))).select(*lifted.columns)


def unmapped(intervals: DataFrame, lifted: DataFrame) -> DataFrame:
    """Intervals with no result (those of unknown names and empty ones among them)."""
    return intervals.join(lifted.select("query_id").distinct(), "query_id", "left_anti")


def lift_counts(intervals: DataFrame, before_filter: DataFrame, after_filter: DataFrame) -> DataFrame:
    """One row: intervals in, unmapped, rows out, rows below the least match."""
    kept = after_filter.groupBy("query_id").agg(F.count("*").alias("kept"))
    made = before_filter.groupBy("query_id").agg(F.count("*").alias("made"))
    rows = intervals.select("query_id").join(made, "query_id", "left").join(kept, "query_id", "left")
    return rows.agg(
        F.count("*").alias("intervals"), F.coalesce(F.sum(F.col("kept").isNull().cast("long")), F.lit(0)).alias("unmapped"),
        F.coalesce(F.sum("kept"), F.lit(0)).alias("rows_out"), (F.coalesce(F.sum("made"), F.lit(0)) - F.coalesce(F.sum("kept"), F.lit(0))).alias("below_min_match"),
    )
