"""The Parquet store of a map, and directories of what a query would read.

``runs`` is written sorted by (a_member, a), or (a_member, b_member, b) for order b,
with a_end and b_end stored so that both ends of a window are pushed to the scan, and
dealt by (a_member, bin of a) so that no file follows one member.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axismap.schema import GROUPS, MEMBERS, META, SECTIONS, MapError, as_runs

CHUNK_RUNS = 8192
CHUNK_SPAN = 1_000_000
BIN = 1 << 20


def write(path: str, runs: DataFrame, members: DataFrame, groups: DataFrame, meta: DataFrame, sections: DataFrame, order: str = "a", codec: str = "zstd", chunk_runs: int = 0) -> None:
    """Write a version of the map beside those that are there, then point to it: readers see the old map or the new one.

    The version before stays, as a map that was read from it may be what is written.
    """
    spark = runs.sparkSession
    old = _versions(spark, path)
    version = f"v{len(old) and int(old[-1][1:].split('-')[0]) + 1:08d}-{uuid.uuid4().hex[:8]}"
    wide = as_runs(runs).withColumn("a_end", F.col("a") + F.col("len")).withColumn("b_end", F.col("b") + F.col("len"))
    by = ["a_member", "a", "b_member", "b", "len", "strand"] if order == "a" else ["a_member", "b_member", "b", "a", "len", "strand"]
    dealt = wide.repartition("a_member", F.floor(F.col("a") / BIN)) if order == "a" else wide.repartition("a_member", "b_member", F.floor(F.col("b") / BIN))
    dealt.sortWithinPartitions(*by).write.option("compression", codec).option("maxRecordsPerFile", chunk_runs).parquet(f"{path}/{version}/runs")
    for name, df in (("members", members), ("groups", groups), ("meta", meta), ("sections", sections)):
        df.write.parquet(f"{path}/{version}/{name}")
    _point_to(spark, path, version)
    for name in old[:-1]:
        _fs(spark, f"{path}/{name}").delete(_path(spark, f"{path}/{name}"), True)


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Versions under ``path`` that were written to the end, oldest first."""
    fs = _fs(spark, path)
    if not fs.exists(_path(spark, path)):
        return []
    marks = [s.getPath().getName() for s in fs.listStatus(_path(spark, path))]
    return sorted(m.removeprefix("_done-") for m in marks if m.startswith("_done-") and m.removeprefix("_done-") in marks)


def _point_to(spark: SparkSession, path: str, version: str) -> None:
    """Mark a version as whole; making an empty file is one step in every store."""
    _fs(spark, path).create(_path(spark, f"{path}/_done-{version}"), True).close()


def current(spark: SparkSession, path: str) -> str:
    """The folder of the latest whole version."""
    found = _versions(spark, path)
    if not found:
        raise MapError(f"no map at {path}")
    return f"{path}/{found[-1]}"


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(runs with a_end and b_end, members, groups, meta, sections)."""
    at = current(spark, path)
    small = [spark.read.schema(s).parquet(f"{at}/{n}") for n, s in (("members", MEMBERS), ("groups", GROUPS), ("meta", META), ("sections", SECTIONS))]
    return (spark.read.parquet(f"{at}/runs"), *small)


def sizes(spark: SparkSession, path: str) -> tuple[int, int]:
    """(chunks, payload bytes): files of the stored runs and their bytes."""
    at = f"{current(spark, path)}/runs"
    files = [s for s in _fs(spark, at).listStatus(_path(spark, at)) if s.getPath().getName().startswith("part-")]
    return len(files), sum(s.getLen() for s in files)


def audit(spark: SparkSession, path: str) -> None:
    """Read every stored page and hold it against its checksum; raises for a damaged file."""
    at = current(spark, path)
    with_checks = spark.read.option("parquet.page.verify-checksum.enabled", "true")
    for name in ("runs", "members", "groups", "meta", "sections"):
        table = with_checks.parquet(f"{at}/{name}")
        table.agg(*[F.max(F.hash(c)) for c in table.columns]).collect()


def window(runs: DataFrame, axis: str, member: int, lo: int, hi: int) -> DataFrame:
    """Runs of a stored map that overlap one window, by predicates that reach the scan."""
    return runs.filter((F.col(f"{axis}_member") == member) & (F.col(axis) < hi) & (F.col(f"{axis}_end") > lo))


def chunk_directory(runs: DataFrame, span: int = CHUNK_SPAN) -> DataFrame:
    """Per (a_member, b_member, bin of a): number of runs and tight extents on both axes."""
    r = as_runs(runs).withColumn("chunk", F.floor(F.col("a") / span))
    return r.groupBy("a_member", "b_member", "chunk").agg(
        F.count("*").alias("runs"), F.min("a").alias("a_min"), F.max(F.col("a") + F.col("len")).alias("a_max"), F.min("b").alias("b_min"), F.max(F.col("b") + F.col("len")).alias("b_max")
    )
