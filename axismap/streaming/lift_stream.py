"""Lifting a stream of intervals through a static map: a stateless stream-static join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axismap.operators.intervals import LEAST_BIN
from axismap.operators.lift import pieces


def lift_stream(runs: DataFrame, intervals: DataFrame, source: str = "a", width: int = 16 * LEAST_BIN) -> DataFrame:
    """Unmerged results of streamed intervals (query_id, member, lo, hi).

    The bin width is given, as a stream cannot be measured first. Merging needs all
    pieces of an interval together; a batch has them, so use ``foreachBatch`` with
    ``operators.lift.merge`` where results must be merged.
    """
    found = pieces(runs, intervals, source, width)
    end = lambda c: F.col(c) + F.col("len")
    return found.select("query_id", "member", F.col("t0").alias("start"), end("t0").alias("end"), "strand", F.col("s0").alias("src_start"), end("s0").alias("src_end"), F.col("len").alias("aligned_bp"))
