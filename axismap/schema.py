"""The data model.

A *run* relates [a, a+len) on a member of axis a to [b, b+len) on a member of axis b;
on strand 1 the second interval is read backwards: a+i meets b+len-1-i. Member ids
are positions in order of first appearance; results that break ties do so by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

RUN_COLUMNS = ["a_member", "a", "b_member", "b", "len", "strand"]
RUNS = T.StructType([T.StructField(c, T.IntegerType() if c == "strand" else T.LongType()) for c in RUN_COLUMNS])
MEMBERS = T.StructType(
    [T.StructField("axis", T.StringType()), T.StructField("member_id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("length", T.LongType()), T.StructField("group_id", T.LongType())]
)
GROUPS = T.StructType([T.StructField("axis", T.StringType()), T.StructField("group_id", T.LongType()), T.StructField("name", T.StringType())])
META = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
SECTIONS = T.StructType([T.StructField("id", T.StringType()), T.StructField("data", T.BinaryType())])
AXES = ("a", "b")


class MapError(ValueError):
    """Input that cannot be a map: overlap, bounds, names, malformed text."""


def other(axis: str) -> str:
    if axis not in AXES:
        raise MapError(f"no axis {axis!r}")
    return "b" if axis == "a" else "a"


def as_runs(df: DataFrame) -> DataFrame:
    """The six run columns in their types, whatever else ``df`` has."""
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in RUNS])
