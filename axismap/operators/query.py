"""Window, point and sweep queries from either axis, and scans in cursor order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axismap.functions.coords import clipped
from axismap.operators.intervals import interval_join
from axismap.schema import RUN_COLUMNS, MapError, as_runs, other

#: The orders in which results are told, all columns of a run breaking ties.
QUERY_ORDER = {"a": ["query_id", "a", "b", "len", "strand", "a_member", "b_member"], "b": ["query_id", "b", "a_member", "a", "len", "strand", "b_member"]}


def check_windows(windows: DataFrame) -> None:
    bad = windows.filter("lo < 0 or hi < lo").limit(1).collect()
    if bad:
        raise MapError(f"a window must have 0 <= lo <= hi: {bad[0].asDict()}")


def _joined(runs: DataFrame, windows: DataFrame, axis: str, width: int | None) -> DataFrame:
    w = windows.select("query_id", F.col("member").alias("__member"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
    return interval_join(w, as_runs(runs), "__member", "__lo", "__hi", f"{axis}_member", axis, "len", width)


def query(runs: DataFrame, windows: DataFrame, axis: str = "a", width: int | None = None) -> DataFrame:
    """What windows (query_id, member, lo, hi) on ``axis`` leave of each run: query_id and a run."""
    far = other(axis)
    met = _joined(runs, windows, axis, width)
    first, there, n = clipped(F.col(axis), F.col("len"), F.col(far), F.col("strand"), F.col("__lo"), F.col("__hi"))
    new = {axis: first, far: there, "len": n}
    return met.select("query_id", *[new[c].alias(c) if c in new else F.col(c) for c in RUN_COLUMNS])


def point(runs: DataFrame, points: DataFrame, axis: str = "a", width: int | None = None) -> DataFrame:
    """Whole runs that cover each point (query_id, member, pos)."""
    windows = points.select("query_id", "member", F.col("pos").alias("lo"), (F.col("pos") + 1).alias("hi"))
    return _joined(runs, windows, axis, width).select("query_id", *RUN_COLUMNS)


def ranked(found: DataFrame, axis: str = "a") -> DataFrame:
    """``found`` with ``nth``: the place of each result within its query, from 0, in the documented order."""
    order = QUERY_ORDER[axis][1:]
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1)


def point_capped(runs: DataFrame, points: DataFrame, cap: int, axis: str = "a", width: int | None = None) -> DataFrame:
    """The first ``cap`` runs of each point in the documented order, with ``total``: how many cover it. With cap 0 only totals: query_id, total."""
    met = point(runs, points, axis, width)
    if cap <= 0:
        return met.groupBy("query_id").agg(F.count("*").alias("total"))
    total = F.count("*").over(Window.partitionBy("query_id"))
    return ranked(met, axis).withColumn("total", total).filter(F.col("nth") < cap)


def sweep(runs: DataFrame, windows: DataFrame, step: int, axis: str = "b", width: int | None = None) -> DataFrame:
    """Runs that cover every ``step``-th position of each window: query_id, pos and a run.

    Windows meet runs as a whole; only positions that a run covers become rows.
    """
    met = _joined(runs, windows, axis, width)
    skipped = F.ceil((F.greatest(F.col(axis), F.col("__lo")) - F.col("__lo")) / step).cast("bigint")
    met = met.withColumn("__first", F.col("__lo") + skipped * step).withColumn("__last", F.least(F.col(axis) + F.col("len"), F.col("__hi")) - 1)
    spots = met.filter("__first <= __last").withColumn("pos", F.explode(F.sequence("__first", "__last", F.lit(step).cast("bigint"))))
    return spots.select("query_id", "pos", *RUN_COLUMNS)


def scan(runs: DataFrame, axis: str, member: int | None = None, others: DataFrame | None = None, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Whole runs in cursor order: by place on ``axis``, then other member, place, length, strand.

    ``others`` (a column ``member_id``) keeps runs whose other member is in it; repeats in it
    change nothing. ``lo``/``hi`` keep runs that overlap the window.
    """
    far = other(axis)
    out = as_runs(runs)
    if member is not None:
        out = out.filter(F.col(f"{axis}_member") == member)
    if lo is not None:
        out = out.filter(F.col(axis) + F.col("len") > lo)
    if hi is not None:
        out = out.filter(F.col(axis) < hi)
    if lo is not None and hi is not None and lo >= hi:
        out = out.limit(0)
    if others is not None:
        out = out.join(others.select(F.col("member_id").alias(f"{far}_member")).distinct(), f"{far}_member", "left_semi").select(*RUN_COLUMNS)
    return out.orderBy(f"{axis}_member", axis, f"{far}_member", far, "len", "strand")


def extent(runs: DataFrame, axis: str, member: int | None = None, others: DataFrame | None = None) -> DataFrame:
    """Per member of ``axis``: lo, hi and number of its (filtered) runs."""
    rows = scan(runs, axis, member, others)
    return rows.groupBy(F.col(f"{axis}_member").alias("member_id")).agg(F.min(axis).alias("lo"), F.max(F.col(axis) + F.col("len")).alias("hi"), F.count("*").alias("runs"))


def representatives(runs: DataFrame, points: DataFrame, width: int | None = None) -> DataFrame:
    """Of the copies that cover a position of axis b, the one with the smallest place on axis a.

    query_id, a_member, a_pos, b_member, strand; equal places go to the smaller member id.
    """
    met = point(runs, points.select("query_id", "member", "pos"), "b", width).join(points.select("query_id", "pos"), "query_id")
    into = F.col("pos") - F.col("b")
    at = F.when(F.col("strand") == 1, F.col("a") + F.col("len") - 1 - into).otherwise(F.col("a") + into)
    best = met.groupBy("query_id").agg(F.min(F.struct(at.alias("a_pos"), F.col("a_member"), F.col("b_member"), F.col("strand"))).alias("x"))
    return best.select("query_id", "x.a_member", "x.a_pos", "x.b_member", "x.strand")


def coverage(runs: DataFrame, axis: str = "b") -> DataFrame:
    """Per member of ``axis``: aligned bases counted once per run, and runs."""
    return as_runs(runs).groupBy(F.col(f"{axis}_member").alias("member_id")).agg(F.sum("len").alias("aligned_bp"), F.count("*").alias("runs"))
