"""Canonical runs, overlap audit, order choice and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axismap.functions.coords import b_of_diagonal, diagonal
from axismap.operators.ordered import islands, max_before, previous_row
from axismap.schema import MapError, as_runs

BIN = 1 << 20


def canonical_runs(runs: DataFrame, bin_width: int = BIN) -> DataFrame:
    """The maximal runs with the same base pairs: union of overlapping and abutting runs of one diagonal.

    Two shuffles of runs, by (diagonal, bin) and, after a map-side combine, by the
    maximal run's start; a diagonal of any length is dealt over its bins.
    """
    keys = ["a_member", "b_member", "strand", "diag"]
    lines = as_runs(runs).withColumn("diag", diagonal()).withColumn("bin", F.floor(F.col("a") / bin_width))
    merged = islands(lines, keys, "bin", ["a", "len"], F.col("a"), F.col("a") + F.col("len"), "first").groupBy(*keys, "first").agg((F.max(F.col("a") + F.col("len")) - F.col("first")).alias("n"))
    n = F.col("n")
    return merged.select("a_member", F.col("first").alias("a"), "b_member", b_of_diagonal(F.col("diag"), F.col("first"), n, F.col("strand")).alias("b"), n.alias("len"), "strand")


def overlap_count(runs: DataFrame, running_max: bool = False, bin_width: int = BIN) -> DataFrame:
    """One row: how many runs start before the end of an earlier one of their a member.

    Earlier means the row just before in (a, b_member, b, len, strand) order, or with
    ``running_max`` any row before; whether the count is zero is the same for both.
    """
    order = ["a", "b_member", "b", "len", "strand"]
    rows = as_runs(runs).withColumn("bin", F.floor(F.col("a") / bin_width))
    if running_max:
        seen = max_before(rows, ["a_member"], "bin", order, F.col("a") + F.col("len"), "reach")
        clash = F.col("a") < F.col("reach")
    else:
        seen = previous_row(rows, ["a_member"], "bin", order, ["a", "len"])
        clash = F.col("a") < F.col("prev.a") + F.col("prev.len")
    return seen.agg(F.coalesce(F.sum(clash.cast("long")), F.lit(0)).alias("overlapping_runs"))


def storage_order(runs: DataFrame, requested: str = "a", allow_overlap: bool = False) -> DataFrame:
    """One row: order, axis_a_overlaps, overlapping_runs and whether the map is refused.

    Without overlap the requested order holds ("auto" means a). With overlap the map is
    refused unless overlap is allowed, which forces order b.
    """
    found = overlap_count(runs)
    clash = F.col("overlapping_runs") > 0
    wanted = "b" if requested == "b" else "a"
    return found.select(
        F.when(clash, "b").otherwise(wanted).alias("order"), clash.alias("axis_a_overlaps"), "overlapping_runs", (clash & F.lit(not allow_overlap)).alias("refused")
    )


def check_presorted(runs: DataFrame, sequence: str) -> DataFrame:
    """One row on runs that claim an order (``sequence`` numbers them): faults by kind.

    ``revisited``: an a member that comes again after another; ``backwards``: an ``a``
    below the row before it in the member.
    """
    rows = runs.select("a_member", "a", F.col(sequence).alias("seq")).withColumn("bin", F.floor(F.col("seq") / BIN))
    heads = previous_row(rows, [], "bin", ["seq"], ["a_member"]).filter("prev is null or prev.a_member != a_member")
    again = heads.groupBy("a_member").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("revisited"))
    inside = previous_row(rows, ["a_member"], "bin", ["seq"], ["a"])
    back = inside.agg(F.coalesce(F.sum((F.col("a") < F.col("prev.a")).cast("long")), F.lit(0)).alias("backwards"))
    return again.crossJoin(back)  # one row each


def integrity(runs: DataFrame, members: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Faults by rule, one row per rule: rule, faults. With ``groups`` their names and the members' groups are held too."""
    r = as_runs(runs)
    sides = []
    for axis in ("a", "b"):
        m = members.filter(F.col("axis") == axis).select(F.col("member_id").alias(f"{axis}_member"), F.col("length").alias(f"{axis}_length"))
        r = r.join(m, f"{axis}_member", "left")
        sides.append(m)
    bad = {
        "negative_coordinate": (F.col("a") < 0) | (F.col("b") < 0),
        "empty_run": F.col("len") < 1,
        "strand": ~F.col("strand").isin(0, 1),
        "undeclared_a": F.col("a_length").isNull(),
        "undeclared_b": F.col("b_length").isNull(),
        "outside_a": F.col("a") + F.col("len") > F.col("a_length"),
        "outside_b": F.col("b") + F.col("len") > F.col("b_length"),
    }
    counted = r.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(k) for k, c in bad.items()])
    names = members.groupBy("axis", "name").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("duplicate_name"))
    wide = counted.crossJoin(names)  # one row each
    rules = [*bad, "duplicate_name"]
    if groups is not None:
        twice = groups.groupBy("axis", "name").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("duplicate_group"))
        lost = members.filter("group_id is not null").join(groups.select("axis", "group_id").distinct(), ["axis", "group_id"], "left_anti").agg(F.count("*").alias("undeclared_group"))
        wide, rules = wide.crossJoin(twice).crossJoin(lost), [*rules, "duplicate_group", "undeclared_group"]  # one row each
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("faults")) for k in rules])).alias("x")).select("x.rule", "x.faults")


def verify(runs: DataFrame, members: DataFrame, groups: DataFrame | None = None) -> str:
    """"OK", or raises with the rules that are broken."""
    broken = [f"{r['rule']}: {r['faults']}" for r in integrity(runs, members, groups).filter("faults > 0").collect()]
    if broken:
        raise MapError("CORRUPT: " + ", ".join(broken))
    return "OK"
