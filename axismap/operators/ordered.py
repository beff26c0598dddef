"""Order-dependent columns over long sequences, without one task per sequence.

A member may hold a third of all runs, so a window partitioned by member would send
them to one task. Here rows are dealt by (keys, bin), a window works inside each bin,
and what a bin must know of those before it (a row, a maximum, the last mark) is
carried over a table with one row per bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _carried(df: DataFrame, keys: list[str], bin_: str, summary: Column, over_bins, name: str) -> DataFrame:
    """``df`` with what ``over_bins`` makes of the bins before each row's own.

    A bin's summary is made where the bin already lies; only summaries are shuffled.
    """
    per_bin = df.groupBy(*keys, bin_).agg(summary.alias("__own"))
    before = Window.partitionBy(*keys).orderBy(bin_)
    carry = per_bin.select(*keys, bin_, over_bins(before).alias(name))
    return df.join(carry, [*keys, bin_])


def previous_row(df: DataFrame, keys: list[str], bin_: str, order: list[str], columns: list[str], name: str = "prev") -> DataFrame:
    """``name``: a struct of ``columns`` of the row before, null at a sequence's start."""
    here, place = F.struct(*columns), F.struct(*order)
    inside = Window.partitionBy(*keys, bin_).orderBy(*order)
    marked = df.withColumn("__in", F.lag(here).over(inside))
    out = _carried(marked, keys, bin_, F.max_by(here, place), lambda w: F.lag("__own").over(w), "__before")
    return out.withColumn(name, F.coalesce("__in", "__before")).drop("__in", "__before")


def max_before(df: DataFrame, keys: list[str], bin_: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``name``: the largest ``value`` of all rows before, null at a sequence's start."""
    inside = Window.partitionBy(*keys, bin_).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    marked = df.withColumn("__v", value).withColumn("__in", F.max("__v").over(inside))
    out = _carried(marked, keys, bin_, F.max("__v"), lambda w: F.max("__own").over(w.rowsBetween(Window.unboundedPreceding, -1)), "__before")
    return out.withColumn(name, F.greatest("__in", "__before")).drop("__v", "__in", "__before")


def last_mark(df: DataFrame, keys: list[str], bin_: str, order: list[str], mark: Column, name: str) -> DataFrame:
    """``name``: the latest non-null ``mark`` up to and with each row; marks grow along the order."""
    inside = Window.partitionBy(*keys, bin_).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = df.withColumn("__v", mark).withColumn("__in", F.last("__v", ignorenulls=True).over(inside))
    out = _carried(marked, keys, bin_, F.max("__v"), lambda w: F.max("__own").over(w.rowsBetween(Window.unboundedPreceding, -1)), "__before")
    return out.withColumn(name, F.coalesce("__in", "__before")).drop("__v", "__in", "__before")


def islands(df: DataFrame, keys: list[str], bin_: str, order: list[str], start: Column, end: Column, name: str) -> DataFrame:
    """``name``: where the island of each interval starts, the union of those of a sequence that overlap or touch.

    ``order`` begins with ``start``. A bin finds its own islands; one table with a row per bin
    then tells how far those before reach, and where the last island there starts: that is
    the last one of a bin, unless all of the bin's lie within what came before.
    """
    inside = Window.partitionBy(*keys, bin_).orderBy(*order)
    marked = df.withColumn("__s", start).withColumn("__e", end)
    marked = marked.withColumn("__reach", F.max("__e").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    first = F.when(F.col("__reach").isNull() | (F.col("__s") > F.col("__reach")), F.col("__s"))
    marked = marked.withColumn("__own", F.last(first, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    before = Window.partitionBy(*keys).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    per_bin = marked.groupBy(*keys, bin_).agg(F.max("__e").alias("__far"), F.max("__own").alias("__last"))
    per_bin = per_bin.withColumn("__upto", F.max("__far").over(before))
    per_bin = per_bin.withColumn("__since", F.max(F.when(F.col("__upto").isNull() | (F.col("__last") > F.col("__upto")), F.col("__last"))).over(before))
    out = marked.join(per_bin.select(*keys, bin_, "__upto", "__since"), [*keys, bin_])
    return out.withColumn(name, F.when(F.col("__own") <= F.col("__upto"), F.col("__since")).otherwise(F.col("__own"))).drop("__s", "__e", "__reach", "__own", "__upto", "__since")


def numbered(df: DataFrame, keys: list[str], order: list, name: str, start: int = 1, bin_: Column | None = None) -> DataFrame:
    """Global numbers along (``keys``, ``bin_``, ``order``): a count within each bin plus what stands before it.

    ``bin_`` must not fall along ``order``; with it no key is one task.
    """
    binned = df.withColumn("__bin", F.lit(0) if bin_ is None else bin_)
    within = Window.partitionBy(*keys, "__bin").orderBy(*order)
    before = Window.orderBy(*keys, "__bin").rowsBetween(Window.unboundedPreceding, -1)  # a row per key and bin
    offsets = binned.groupBy(*keys, "__bin").agg(F.count("*").alias("__n")).select(*keys, "__bin", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    out = binned.join(offsets, [*keys, "__bin"]).withColumn(name, F.row_number().over(within) + F.col("__offset") + (start - 1))
    return out.drop("__offset", "__bin")
