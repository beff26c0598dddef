"""Ordered folds over groups that arrive as contiguous, sorted rows.

Rows are hash-partitioned by the group, sorted within partitions, and one Python
function sees a partition's Arrow batches as they come. There is no call per group,
and no group is held unless its fold needs it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str], fold: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str, at_once: int = 20_000, dealt: bool = False) -> DataFrame:
    """Rows that ``fold`` makes of the rows (tuples of ``columns``) of each partition in turn.

    All rows of one value of ``keys`` come together, sorted by ``order``. ``dealt`` says that
    a window over some of ``keys`` has put them into one partition already.
    """
    sorted_rows = (df if dealt else df.repartition(*keys)).sortWithinPartitions(*keys, *order).select(*columns)
    fields = [x.strip().split(" ") for x in schema.split(",")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    names, types = [f[0] for f in fields], [kinds[f[1]] for f in fields]

    def run(batches):
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        held: list[tuple] = []
        for out in fold(rows):
            held.append(out)
            if len(held) >= at_once:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    return sorted_rows.mapInArrow(run, schema)
