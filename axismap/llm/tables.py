"""Shared plumbing of the corpus operators: reading inputs and cutting lineage.

Lineage is cut by writing a Parquet table into the folder that the cluster names
in ``spark.checkpoint.dir``; every executor can read it, so a lost executor costs
a re-read and never a lost block.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_AT_ONCE = 1000
BROADCAST_BYTES = 64 << 20
IDENTITY = ["none", "id", "same"]
_written: dict[str, list[str]] = {}
_own: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The input table ``name``; only Spark opens the path, so any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(names: Iterable[str], wanted: str) -> str:
    """``wanted``, or it with as many underscores as no name of ``names`` has (in any case of letters)."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where unset, a local session gets an own folder; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="axismap-")
        _own[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


_kept: dict[str, dict] = {}


def kept_for(operator: str) -> dict:
    """What a worker process keeps between tasks of an operator; what it kept for others goes, which bounds its memory."""
    if operator not in _kept:
        _kept.clear()
        give_back()
    return _kept.setdefault(operator, {})


def give_back() -> None:
    """Return freed memory to the system, where the C library can: a worker process outlives its operator."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def give_room(spark: SparkSession) -> None:
    """Let the executors' JVMs return what they no longer use, heap and direct buffers, to the system.

    A JVM keeps its heap at what an earlier step needed until it happens to collect all of it;
    worker processes of the next step need that room beside it.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("reflect('java.lang.System', 'gc') AS gone").write.format("noop").mode("overwrite").save()


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def mark(spark: SparkSession) -> int:
    """How many tables are stashed; see ``release``."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, keep: Iterable[DataFrame] = ()) -> None:
    """Delete the tables stashed since a ``mark`` but those that ``keep`` reads; results that still read one become unusable."""
    read_ = "\n".join(x for df in keep for x in df.inputFiles())
    every = _written.get(spark.sparkContext.applicationId, [])
    gone = [p for p in every[since:] if p.rpartition("/")[2] not in read_]
    _delete(spark, gone)
    _written[spark.sparkContext.applicationId] = [p for p in every if p not in gone]


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of few rows, which bounds what Python holds of them at once."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def identity(key: str, text: str) -> list[Column]:
    """What tells rows apart (IDENTITY), null nowhere: whether the id is null, the id as text, a hash of the text."""
    return [F.col(f"`{key}`").isNull(), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))]


def stay(docs: DataFrame, fates: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` without the rows whose identity ``fates`` (IDENTITY, gone) marks as gone, and with one row of each other that it names.

    Texts are not shuffled: the fates are broadcast if their measured size is within
    ``BROADCAST_BYTES``; beyond that the same join runs on their identity. Only rows of
    which one stays are grouped, each task's copies first.
    """
    n, size, ones = fates.agg(F.count("*"), F.coalesce(F.sum(F.length("id")), F.lit(0)), F.coalesce(F.sum((~F.col("gone")).cast("int")), F.lit(0))).first()
    names = [unused(docs.columns, f"{x}__") for x in (*IDENTITY, "gone")]
    own = [F.col(f"`{c}`") for c in docs.columns]
    told = docs.select(*own, *[c.alias(x) for c, x in zip(identity(key, text), names, strict=False)])
    f = fates.select(*IDENTITY, "gone").toDF(*names)
    met = told.join(F.broadcast(f) if 64 * n + size <= BROADCAST_BYTES else f, names[:3], "left")
    rest = met.filter(F.col(names[3]).isNull()).select(*own)
    if not ones:
        return rest
    return rest.unionByName(met.filter(~F.col(names[3])).dropDuplicates(names[:3]).select(*own))
