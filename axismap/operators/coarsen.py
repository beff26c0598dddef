"""Level of detail: runs of one pair of members joined over small gaps.

Along the key axis there is one open chain per other member, whatever the strand; a
run that cannot extend it closes it. A forward chain measures the other axis's gap
from its *start plus its key span*, which drifts from the last run's end, so the
forward rule needs the chain's start and is a fold. What it cannot do without (one
strand, a key gap in range, and on strand 1 the other gap, which is exact there) is
checked against the row before, which cuts the sequence into segments first; a run
alone in its segment is a chain as it is.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axismap.operators.canonical import canonical_runs
from axismap.operators.ordered import last_mark, previous_row
from axismap.operators.streams import ordered_fold
from axismap.schema import RUN_COLUMNS, as_runs, other

BIN = 1 << 20


def chains(runs: DataFrame, key: str, max_gap: int, bin_width: int = BIN) -> DataFrame:
    """Open chains as closed: km, k, om, o, len, strand."""
    far = other(key)
    r = as_runs(runs).select(F.col(f"{key}_member").alias("km"), F.col(key).alias("k"), F.col(f"{far}_member").alias("om"), F.col(far).alias("o"), "len", "strand")
    r = r.withColumn("bin", F.floor(F.col("k") / bin_width))
    order = ["k", "o", "len", "strand"]
    r = previous_row(r, ["km", "om"], "bin", order, ["k", "o", "len", "strand"])
    kg = F.col("k") - F.col("prev.k") - F.col("prev.len")
    og = F.col("prev.o") - F.col("o") - F.col("len")
    goes_on = (F.col("strand") == F.col("prev.strand")) & kg.between(0, max_gap) & ((F.col("strand") == 0) | og.between(0, max_gap))
    new = F.when(F.coalesce(goes_on, F.lit(False)), F.lit(None)).otherwise(F.struct(*order))
    r = last_mark(r, ["km", "om"], "bin", order, new, "seg")

    def fold(rows):
        for (km, om, *_), group in groupby(rows, key=lambda x: x[:6]):
            k0 = o0 = n0 = s0 = None
            for *_, k, o, n, strand in group:
                if k0 is not None:
                    across = o0 - (o + n) if strand else o - (o0 + n0)
                    if s0 == strand and 0 <= k - k0 - n0 <= max_gap and 0 <= across <= max_gap:
                        n0 = k + n - k0
                        o0 = o if strand else o0
                        continue
                    yield km, k0, om, o0, n0, s0
                k0, o0, n0, s0 = k, o, n, strand
            yield km, k0, om, o0, n0, s0

    r = r.select("km", "om", *[F.col(f"seg.{c}").alias(f"s_{c}") for c in order], *order)
    seg = ["km", "om", *[f"s_{c}" for c in order]]
    r = r.withColumn("n", F.count("*").over(Window.partitionBy(*seg)))
    out = ["km", "k", "om", "o", "len", "strand"]
    folded = ordered_fold(r.filter("n > 1"), seg, order, [*seg, *order], fold, "km bigint, k bigint, om bigint, o bigint, len bigint, strand int", dealt=True)
    return folded.unionByName(r.filter("n = 1").select(*out))


def clip_to_members(closed: DataFrame, lengths: DataFrame) -> DataFrame:
    """Chains cut at the end of the other member (member_id, length), with ``excess`` cut off.

    Forward chains lose their end, backward ones their start on the key axis; a chain
    that would lose everything has len 0.
    """
    m = closed.join(lengths.select(F.col("member_id").alias("om"), F.col("length").alias("__length")), "om")
    over = F.greatest(F.lit(0), F.col("o") + F.col("len") - F.col("__length"))
    m = m.withColumn("excess", F.least(over, F.col("len")))
    return m.select("km", F.when(F.col("strand") == 1, F.col("k") + F.col("excess")).otherwise(F.col("k")).alias("k"), "om", "o", (F.col("len") - F.col("excess")).alias("len"), "strand", "excess")


def coarsen(runs: DataFrame, key: str, max_gap: int, lengths: DataFrame) -> DataFrame:
    """The canonical runs of the clipped chains; ``lengths`` are of the other axis's members."""
    far = other(key)
    cut = clip_to_members(chains(runs, key, max_gap), lengths).filter("len > 0")
    name = {f"{key}_member": "km", key: "k", f"{far}_member": "om", far: "o", "len": "len", "strand": "strand"}
    return canonical_runs(cut.select(*[F.col(name[c]).alias(c) for c in RUN_COLUMNS]))


def coarsen_stats(runs: DataFrame, key: str, max_gap: int, lengths: DataFrame) -> DataFrame:
    """One row: runs_in, chains_out (before they are made canonical), clipped_bp, dropped."""
    cut = clip_to_members(chains(runs, key, max_gap), lengths)
    made = cut.agg(
        F.coalesce(F.sum((F.col("len") > 0).cast("long")), F.lit(0)).alias("chains_out"), F.coalesce(F.sum(F.when(F.col("len") > 0, F.col("excess"))), F.lit(0)).alias("clipped_bp"),
        F.coalesce(F.sum((F.col("len") <= 0).cast("long")), F.lit(0)).alias("dropped"),
    )
    return runs.agg(F.count("*").alias("runs_in")).crossJoin(made)  # one row each
