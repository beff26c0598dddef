"""Sharding: sampled splitters over a hash key, groups of equal texts whole, near-equal bytes.

Only DataFrame expressions. The key is the hash of a text, so equal texts stand together.

1. Keys are drawn with a chance in proportion to size, ``DRAWS`` for each of ``RANGES``
   ranges a shard. Texts drawn twice or more are measured over all rows; those of at least
   ``BIG`` of a shard are dealt first, whole, the largest to the emptiest shard. Only a text
   that no shard can hold is split, row by row.
2. Quantiles of the other draws are the splitters. Rows are range-partitioned by them and
   each range is measured. What is left of each shard's share gives 39 targets; the range
   that would overfill a shard holds one, and is subdivided into ``PARTS`` again and again
   until a part holds less than ``FINE`` of a shard or one key. The shard's bound is there.
3. A row's shard is the number of bounds up to its key, or its text's own shard. Slots
   count on over (shard, task), so no shard is one task.

Rows are read once and written narrow (id, hash, size, checksum); texts never move. The
driver gets, and rows are joined with, tables that depend on the number of shards only: at
most 2 x ``DRAWS`` x ``RANGES`` x shards draws, ``RANGES`` x shards ranges, shards / ``BIG``
big texts, shards x ``PARTS`` parts a round.

Defined results: a null text has no bytes and size 16, and is equal to an empty text; null
and repeated ids are ordinary rows, each with a slot of its own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from heapq import heapify, heapreplace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axismap.llm.tables import stash

OVERHEAD = 16
RANGES = 64
DRAWS = 24
PREFIX_BITS = 12
BIG = 0.01
FINE = 0.002
PARTS = 64
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def narrow_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, h, size, text_crc32, and place: the task in its upper bits, the row of the task below."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    return docs.select(
        F.col(f"`{key}`").alias("key"), F.xxhash64(body).alias("h"), (F.octet_length(body).cast("long") + OVERHEAD).alias("size"), F.crc32(body).alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"),
    )


def draw(rows: DataFrame, total: int, draws: int) -> DataFrame:
    """(h, w): keys drawn with a chance in proportion to size, w draws each."""
    share = F.col("size") * F.lit(draws / total)
    chance = F.xxhash64("place", "h", F.lit("draw")).cast("double") / F.lit(2.0**64) + 0.5
    return rows.filter(chance < share).select("h", F.greatest(share, F.lit(1.0)).alias("w"))


def splitters(drawn: DataFrame, n_ranges: int) -> DataFrame:
    """(p, base, cuts): for each key prefix the splitters before it and, sorted, those in it."""
    by_key = Window.orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = drawn.groupBy("h").agg(F.sum("w").alias("w"))
    placed = per.withColumn("upto", F.sum("w").over(by_key)).withColumn("all", F.sum("w").over(Window.partitionBy()))
    quantile = lambda c: F.floor(c * n_ranges / F.col("all"))
    cuts = placed.filter(quantile(F.col("upto")) > quantile(F.col("upto") - F.col("w"))).withColumn("p", F.shiftright("h", 64 - PREFIX_BITS))
    cuts = cuts.groupBy("p").agg(F.array_sort(F.collect_list("h")).alias("cuts"))
    half = 1 << (PREFIX_BITS - 1)
    every = drawn.sparkSession.range(-half, half, 1, 1).select(F.col("id").alias("p")).join(cuts, "p", "left")
    every = every.withColumn("cuts", F.coalesce("cuts", F.array().cast("array<bigint>")))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    return every.withColumn("base", F.coalesce(F.sum(F.size("cuts")).over(before), F.lit(0)))


def into_ranges(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """``rows`` with ``range``: the number of splitters below their key (one that equals it ends the range)."""
    met = rows.withColumn("p", F.shiftright("h", 64 - PREFIX_BITS)).join(F.broadcast(splits), "p")
    return met.withColumn("range", F.col("base") + F.size(F.filter("cuts", lambda c: c < F.col("h")))).drop("p", "base", "cuts")


def deal_big(big: list[tuple[int, int, int]], total: int, n_shards: int) -> tuple[list[int], dict[int, int], dict[int, list[tuple[int, int]]]]:
    """(bytes by shard, shard of a whole text, (rows upto, shard) of a split one), largest texts first.

    ``big`` are (h, bytes, rows). Rows of a split text are all of one size.
    """
    load = [(0, s) for s in range(n_shards)]
    heapify(load)
    fair = total / n_shards
    whole, split = {}, {}
    for h, size, n in sorted(big, key=lambda b: (-b[1], b[0])):
        if size <= fair:
            filled, s = load[0]
            whole[h] = s
            heapreplace(load, (filled + size, s))
            continue
        each, parts, at = size / n, [], 0
        while at < n:
            filled, s = load[0]
            take = min(n - at, max(1, round((fair - filled) / each)))
            at += take
            parts.append((at, s))
            heapreplace(load, (filled + round(take * each), s))
        split[h] = parts
    return [b for b, _ in sorted(load, key=lambda x: x[1])], whole, split


def _values(spark, rows: list[tuple], names: str) -> DataFrame:
    if not rows:
        return spark.sql(f"SELECT * FROM VALUES ({', '.join(['0L'] * len(names.split(',')))}) AS t({names}) WHERE false")
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(f'CAST({v} AS BIGINT)' for v in r) + ')' for r in rows)} AS t({names})")


def bounds(rows: DataFrame, drawn: DataFrame, targets: list[float], fine: float, n_ranges: int) -> list[int]:
    """For each target the key such that the rows up to it hold nearest to so many bytes."""
    spark = rows.sparkSession
    ranged = into_ranges(rows, splitters(drawn, n_ranges))
    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.min("h").alias("lo"), F.max("h").alias("hi")).orderBy("range").collect()
    found: list[int | None] = [None] * len(targets)
    open_: dict[int, tuple[int, int, int, int]] = {}  # target: first key, last key, bytes before, bytes

    def narrow(k: int, parts: list[tuple[int, int, int]], before: int) -> None:
        """Settle target ``k`` in one of ``parts`` (first key, last key, bytes), or leave the part to be subdivided."""
        upto, at = [], before
        for _, _, size in parts:
            at += size
            upto.append(at)
        i = bisect_right(upto, targets[k])
        if i == len(parts):
            found[k] = parts[-1][1] if parts else MOST
            return
        lo, hi, size = parts[i]
        start = upto[i] - size
        if lo == hi or size <= fine:
            near = targets[k] - start >= size / 2
            found[k] = hi if near else (parts[i - 1][1] if i else lo - 1)
            return
        open_[k] = lo, hi, start, size

    every = [(r["lo"], r["hi"], r["bytes"]) for r in sums]
    for k in range(len(targets)):
        narrow(k, every, 0)
    while open_:
        now, open_ = open_, {}
        spans = sorted({(lo, hi) for lo, hi, _, _ in now.values()})
        spread = _values(spark, [(i, lo, hi, max(1, -(-(hi - lo + 1) // PARTS))) for i, (lo, hi) in enumerate(spans)], "span, lo, hi, step")
        inside = rows.join(F.broadcast(spread), (F.col("h") >= F.col("lo")) & (F.col("h") <= F.col("hi")))
        part = F.expr("div(CAST(h AS DECIMAL(20, 0)) - lo, step)")
        got = inside.groupBy("span", part.alias("part")).agg(F.min("h").alias("first"), F.max("h").alias("last"), F.sum("size").alias("bytes")).orderBy("span", "part").collect()
        for k, (lo, hi, start, _) in now.items():
            narrow(k, [(r["first"], r["last"], r["bytes"]) for r in got if r["span"] == spans.index((lo, hi))], start)
    return found


def _upto(key: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` lie below ``key``."""
    if not cuts:
        return F.lit(0)
    if len(cuts) == 1:
        return F.when(key > F.lit(cuts[0]), 1).otherwise(0)
    half = len(cuts) // 2
    return F.when(key > F.lit(cuts[half]), F.lit(half + 1) + _upto(key, cuts[half + 1 :])).otherwise(_upto(key, cuts[:half]))


def shard(docs: DataFrame, n_shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``docs``: key, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    rows = stash(narrow_rows(docs, key, text), "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 1
    n_ranges = RANGES * n_shards
    drawn = stash(draw(rows, total, n_ranges * DRAWS), "shard-draws")
    twice = drawn.groupBy("h").agg(F.sum("w").alias("w")).filter("w >= 2").select("h")
    measured = rows.join(F.broadcast(twice), "h").groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    big = [(r["h"], r["bytes"], r["n"]) for r in measured.filter(F.col("bytes") >= BIG * total / n_shards).collect()]
    load, whole, split = deal_big(big, total, n_shards)
    own = F.broadcast(_values(spark, [(h,) for h, _, _ in big], "h"))
    small = rows.join(own, "h", "left_anti")
    # the shares that big texts leave, in turn
    left, fair = sum(s for _, s, _ in big), total / n_shards
    rest = [max(0.0, fair - b) for b in load]
    scale = (total - left) / (sum(rest) or 1)
    targets, at = [], 0.0
    for share in rest[:-1]:
        at += share * scale
        targets.append(at)
    cuts = bounds(small, drawn.join(own, "h", "left_anti"), targets, FINE * fair, n_ranges) if total > left else []

    told = rows.join(F.broadcast(_values(spark, sorted(whole.items()), "h, own_shard")), "h", "left")
    told = told.withColumn("shard", F.coalesce("own_shard", _upto(F.col("h"), sorted(cuts)))).drop("own_shard")
    if split:
        told = _split_rows(told, split)
    told = told.withColumn("task", F.shiftright("place", 33)).withColumn("shard", F.col("shard").cast("int"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = told.groupBy("shard", "task").agg(F.count("*").alias("n")).select("shard", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("shard", "task").orderBy("place"))
    placed = told.withColumn("nth", nth).join(firsts, ["shard", "task"])
    return placed.select(F.col("key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _split_rows(told: DataFrame, split: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """``told`` with the shards of split texts, whose rows are counted on over the tasks."""
    spark = told.sparkSession
    names = F.broadcast(_values(spark, [(h,) for h in sorted(split)], "h"))
    mine = told.join(names, "h", "left_semi").withColumn("task", F.shiftright("place", 33))
    before = Window.partitionBy("h").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = mine.groupBy("h", "task").agg(F.count("*").alias("n")).select("h", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = mine.withColumn("nth", F.row_number().over(Window.partitionBy("h", "task").orderBy("place"))).join(firsts, ["h", "task"])
    ranked = ranked.withColumn("rank", F.col("first") + F.col("nth") - 1)
    parts = _values(spark, [(h, a, b, s) for h, p in sorted(split.items()) for (a, (b, s)) in zip([0, *[u for u, _ in p]], p, strict=False)], "p_h, from, upto, own_shard")
    dealt = ranked.join(F.broadcast(parts), (F.col("h") == F.col("p_h")) & (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("upto")))
    return told.join(names, "h", "left_anti").unionByName(dealt.select(*[c for c in told.columns if c != "shard"], F.col("own_shard").alias("shard")))
