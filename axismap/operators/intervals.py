"""The interval join: overlap on one axis as an equi-join on (member, level, bin).

Intervals are spread over the bins that they touch. A level's bins are ``STEP`` times as
wide as those of the level below, and an interval belongs to the lowest level where it
touches at most ``SPREAD`` + 1 bins, so one long interval among short ones never becomes
many rows. A pair meets at the higher of its two levels: windows stand on their level and all
above, runs on their own and on those above that windows have. Only windows are measured,
which are given and not computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BIN = 256
STEP = 256
SPREAD = 16
LEVELS = 5


def _level(size: Column, width: int) -> Column:
    return sum(((size > SPREAD * width * STEP**k).cast("int") for k in range(LEVELS - 1)), F.lit(0))


def measured(windows: DataFrame, lo: str, hi: str) -> tuple[int, list[int]]:
    """(bin width, levels that the windows have), from how many have which power of two as their size."""
    bits = F.length(F.bin(F.col(hi) - F.col(lo) - 1))
    counts = {r["bits"]: r["n"] for r in windows.filter(F.col(lo) < F.col(hi)).groupBy(bits.alias("bits")).agg(F.count("*").alias("n")).collect()}
    upto, most = 0, sum(counts.values()) * 0.95
    for b in sorted(counts):
        upto += counts[b]
        if upto >= most:
            width = max(LEAST_BIN, 1 << b)
            break
    else:
        return LEAST_BIN, []
    return width, sorted({sum((1 << b) > SPREAD * width * STEP**k for k in range(LEVELS - 1)) for b in counts})


def _on_level(k: int):
    return lambda b: F.struct(F.lit(k).alias("level"), b.alias("bin"))


def _places(lo: Column, hi: Column, width: int, own: Column, on: list[Column]) -> Column:
    """(level, bin) of an interval on each level that ``on`` allows."""
    none = F.array().cast("array<struct<level:int,bin:bigint>>")
    parts = []
    for k in range(LEVELS):
        w = width * STEP**k
        bins = F.sequence(F.floor(lo / w), F.floor((hi - 1) / w))
        parts.append(F.when(on[k], F.transform(bins, _on_level(k))).otherwise(none))
    return F.concat(*parts)


def interval_join(windows: DataFrame, runs: DataFrame, member: str, lo: str, hi: str, run_member: str, start: str, n: str, width: int | None = None) -> DataFrame:
    """Pairs of a window [lo, hi) and a run [start, start+n) of one member that overlap.

    A pair counts in the first bin that both touch, so no distinct is needed. Empty windows
    meet nothing. A crowded bin is split by the adaptive skew join. Neither side is broadcast:
    both are spread, which Spark's estimates of their sizes leave out. With ``width`` nothing
    is measured. Column names of the sides must differ.
    """
    width, used = (width, list(range(LEVELS))) if width else measured(windows, lo, hi)
    end = F.col(start) + F.col(n)
    own, run_own = _level(F.col(hi) - F.col(lo), width), _level(F.col(n), width)
    w = windows.filter(F.col(lo) < F.col(hi)).withColumn("__own", own)
    w = w.withColumn("__at", F.explode(_places(F.col(lo), F.col(hi), width, own, [F.col("__own") <= k for k in range(LEVELS)])))
    w = w.withColumn("__level", F.col("__at.level")).withColumn("__bin", F.col("__at.bin")).drop("__at")
    r = runs.filter(F.col(n) > 0).withColumn("__run_own", run_own)
    on = [((F.col("__run_own") == k) & F.lit(any(u <= k for u in used))) | ((F.col("__run_own") < k) & F.lit(k in used)) for k in range(LEVELS)]
    r = r.withColumn("__run_at", F.explode(_places(F.col(start), end, width, run_own, on)))
    r = r.withColumn("__run_level", F.col("__run_at.level")).withColumn("__run_bin", F.col("__run_at.bin")).drop("__run_at")
    wide = F.element_at(F.array(*[F.lit(width * STEP**k) for k in range(LEVELS)]), F.col("__level") + 1)
    met = (F.col(member) == F.col(run_member)) & (F.col("__level") == F.col("__run_level")) & (F.col("__bin") == F.col("__run_bin"))
    first = F.greatest(F.floor(F.col(lo) / wide), F.floor(F.col(start) / wide))
    here = (F.col("__level") == F.greatest("__own", "__run_own")) & (F.col("__bin") == first)
    return w.hint("merge").join(r, met & (F.col(start) < F.col(hi)) & (end > F.col(lo)) & here).drop("__own", "__level", "__bin", "__run_own", "__run_level", "__run_bin")
