"""Members (sequences), groups and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axismap.functions.coords import group_name
from axismap.schema import AXES, MapError, as_runs


def from_sightings(seen: DataFrame) -> DataFrame:
    """Members from (axis, name, length, seq): ids in order of first appearance.

    A name with two lengths is refused.
    """
    per = seen.groupBy("axis", "name").agg(F.min("seq").alias("first"), F.min("length").alias("length"), F.max("length").alias("most"))
    clash = per.filter("length != most").limit(1).collect()
    if clash:
        raise MapError(f"sequence {clash[0]['name']!r} has two lengths: {clash[0]['length']} and {clash[0]['most']}")
    within = Window.partitionBy("axis").orderBy("first", "name")
    return per.select("axis", (F.row_number().over(within) - 1).cast("bigint").alias("member_id"), "name", "length", F.lit(None).cast("bigint").alias("group_id"))


def by_rank(members: DataFrame, axis: str) -> DataFrame:
    """Members of an axis with ``name_rank``, their place in byte order of names, from 0."""
    own = members.filter(F.col("axis") == axis)
    return own.withColumn("name_rank", F.row_number().over(Window.partitionBy("axis").orderBy("name")) - 1)


def by_name(members: DataFrame, axis: str, name: str) -> DataFrame:
    return members.filter((F.col("axis") == axis) & (F.col("name") == name))


def by_prefix(members: DataFrame, axis: str, prefix: str) -> DataFrame:
    """One row: first_rank and count of the names that start with ``prefix``."""
    ranked = by_rank(members, axis)
    hit = F.col("name").startswith(prefix)
    return ranked.agg(F.coalesce(F.min(F.when(hit, F.col("name_rank"))), F.lit(0)).alias("first_rank"), F.coalesce(F.sum(hit.cast("long")), F.lit(0)).alias("count"))


def extents(members: DataFrame, runs: DataFrame) -> DataFrame:
    """Members with axis_min and axis_max of their runs (0 and 0 without any)."""
    sides = [as_runs(runs).groupBy(F.col(f"{x}_member").alias("member_id")).agg(F.min(x).alias("axis_min"), F.max(F.col(x) + F.col("len")).alias("axis_max")).withColumn("axis", F.lit(x)) for x in AXES]
    found = sides[0].unionByName(sides[1])
    return members.join(found, ["axis", "member_id"], "left").select(*[members[c] for c in members.columns], F.coalesce("axis_min", F.lit(0)).alias("axis_min"), F.coalesce("axis_max", F.lit(0)).alias("axis_max"))


def assign_groups(members: DataFrame, separator: str, fields: int = 1) -> tuple[DataFrame, DataFrame]:
    """(members with group_id, groups): groups from names, ids in order of member ids."""
    named = members.withColumn("group_name", group_name(F.col("name"), separator, fields))
    firsts = named.filter("group_name is not null").groupBy("axis", "group_name").agg(F.min("member_id").alias("first"))
    ids = firsts.select("axis", (F.row_number().over(Window.partitionBy("axis").orderBy("first")) - 1).cast("bigint").alias("group_id"), F.col("group_name").alias("name"))
    put = named.drop("group_id").join(ids.select("axis", "group_id", F.col("name").alias("group_name")), ["axis", "group_name"], "left")
    return put.select("axis", "member_id", "name", "length", "group_id"), ids


def group_members(members: DataFrame, groups: DataFrame, axis: str, group: str) -> DataFrame:
    """Members of a group, in name order."""
    own = groups.filter((F.col("axis") == axis) & (F.col("name") == group)).select("axis", "group_id")
    return members.join(own, ["axis", "group_id"]).select(*members.columns).orderBy("name")


def group_totals(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group: axis, group, members, total length."""
    g = groups.select("axis", "group_id", F.col("name").alias("group_name"))
    return g.join(members, ["axis", "group_id"], "left").groupBy("axis", "group_name").agg(F.count("member_id").alias("members"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_length"))


def group_sums(members: DataFrame) -> DataFrame:
    """Members of an axis and their lengths, whatever their group: n and total."""
    return members.groupBy("axis").agg(F.count("*").alias("members"), F.sum("length").alias("total_length"))


def last_write(meta: DataFrame, sequence: str) -> DataFrame:
    """key, value in key order; of several writes of a key the last by ``sequence`` holds."""
    bad = meta.filter((F.octet_length("key") < 1) | (F.octet_length("key") > 255) | F.col("key").contains("\0")).limit(1).collect()
    if bad:
        raise MapError(f"bad metadata key {bad[0]['key']!r}")
    return meta.groupBy("key").agg(F.max_by("value", sequence).alias("value")).orderBy("key")


