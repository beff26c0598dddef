"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Only DataFrame expressions. A text is lower-cased in A-Z and cut into words (runs
of digits, letters and characters beyond ASCII). A benchmark item gives every run
of ``n`` consecutive words, an item of fewer words its one whole run. Document
windows are hashed inside one code-generated stage, probed against the broadcast
set, and a hit counts only if its words are equal, so hash collisions change
nothing. Texts are read in one pass whatever lengths the benchmark's windows have, and
no window of a document is shuffled unless it hits.

The set is broadcast only if its measured size is within ``BROADCAST_BYTES``;
beyond that the same condition runs as a sort-merge join on the window hash.

Defined results: a null or wordless text has no words and no hits; null item ids
count as the empty string; equal items under one id count once; repeated document
rows each keep their own result row; an empty benchmark hits nothing; an empty
document table gives an empty result. Other columns, whatever their names, pass
through ``decontaminate`` untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axismap.llm.tables import BROADCAST_BYTES, IDENTITY, identity, stash, stay, unused

WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything but digits, a-z and what lies beyond ASCII, in lower-cased text.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Where a word starts after a separator, in text as it stands.
WORD_STARTS = r"(?<=[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])(?=[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])"


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _window(k: int) -> list[Column]:
    return [F.get("words", F.col("pos") + j) for j in range(k)]


def _positions(df: DataFrame, k: int) -> DataFrame:
    """A row per window of ``k`` words: pos, h (its hash), win (its words)."""
    starts = F.when(F.size("words") >= k, F.sequence(F.lit(0), F.size("words") - k))
    return df.select("*", F.explode(starts).alias("pos")).select("*", F.xxhash64(*_window(k)).alias("h"), F.array(*_window(k)).alias("win"))


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """(k, h, win, items): each distinct window with the sorted ids that contain it."""
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("words"))
    items = items.withColumn("k", F.least(F.size("words"), F.lit(n))).filter("k > 0")
    parts = [_positions(items.filter(F.col("k") == k), k) for k in range(1, n + 1)]
    every = reduce(DataFrame.unionByName, [p.select("k", "h", "win", "item") for p in parts])
    return every.groupBy("k", "h", "win").agg(F.sort_array(F.collect_set("item")).alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per distinct (key, text): copies, n_words, spans (sorted [pos, end)), items."""
    windows = benchmark_windows(benchmark, n)
    size = windows.groupBy("k").agg(F.sum(F.length(F.concat_ws(" ", "win")) + F.length(F.concat_ws(" ", "items")) + 64).alias("bytes")).collect()
    lengths = sorted(r["k"] for r in size) or [n]
    fits = sum(r["bytes"] for r in size) <= BROADCAST_BYTES
    base = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("th"), words(F.col(f"`{text}`")).alias("words"))
    # one pass: at each place a window of every length that the benchmark has
    starts = F.when(F.size("words") >= lengths[0], F.sequence(F.lit(0), F.size("words") - lengths[0]))
    spread = base.select("*", F.explode_outer(starts).alias("pos"))
    if len(lengths) == 1:
        spread = spread.select("*", F.lit(lengths[0]).alias("k"), F.when(F.col("pos").isNotNull(), F.xxhash64(*_window(lengths[0]))).alias("h"))
    else:
        every = F.array(*[F.struct(F.lit(k).alias("k"), F.xxhash64(*_window(k)).alias("h")) for k in lengths])
        fit = F.when(F.col("pos").isNotNull(), F.filter(every, lambda w: F.col("pos") + w["k"] <= F.size("words")))
        spread = spread.select("*", F.explode_outer(fit).alias("w")).select("key", "th", "words", "pos", "w.k", "w.h")
    probe = spread.select("key", "th", F.size("words").cast("long").alias("n_words"), "pos", "k", "h", F.slice("words", F.col("pos") + 1, F.col("k")).alias("win"))
    known = windows.select(F.col("k").alias("b_k"), F.col("h").alias("b_h"), F.col("win").alias("b_win"), "items")
    known = F.broadcast(known) if fits else known.hint("merge")
    same = (F.col("win") <= F.col("b_win")) & (F.col("win") >= F.col("b_win"))  # not a join key: only read where hashes meet
    first = F.col("pos").isNull() | ((F.col("pos") == 0) & (F.col("k") == lengths[0]))
    joined = probe.join(known, (F.col("h") == F.col("b_h")) & (F.col("k") == F.col("b_k")) & same, "left").filter(first | F.col("items").isNotNull())
    span = F.when(F.col("items").isNotNull(), F.struct("pos", (F.col("pos") + F.col("k")).alias("end")))
    found = joined.select("key", "th", "n_words", first.cast("int").alias("first"), span.alias("span"), "items")
    return found.groupBy("key", "th").agg(
        F.sum("first").alias("copies"), F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def covered(spans: Column) -> Column:
    """How many positions sorted spans cover together."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["pos"], a["upto"]))).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto")
    )
    return F.aggregate(spans, start, step, lambda a: a["n"])


def report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    per = hits(docs, benchmark, n, key, text).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    n_hit = covered(F.col("spans"))
    return per.select(
        F.col("key").alias(key), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "documents", n: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without hit documents ("documents") or without hit words ("spans").

    A hit word goes together with the separators up to the next word.
    """
    if action not in ("documents", "spans"):
        raise ValueError(f"unknown action {action!r}")
    hit = hits(docs, benchmark, n, key, text).filter(F.size("spans") > 0)
    hit = stash(hit.select(F.col("key").isNull().alias("none"), F.coalesce(F.col("key").cast("string"), F.lit("")).alias("id"), F.col("th").alias("same"), "spans"), "decontaminate-hits")
    if action == "documents":
        return stay(docs, hit.select(*IDENTITY, F.lit(True).alias("gone")), key, text)
    names = [unused(docs.columns, f"{x}__") for x in (*IDENTITY, "spans")]
    told = docs.select("*", *[c.alias(x) for c, x in zip(identity(key, text), names, strict=False)])
    size = hit.agg(F.coalesce(F.sum(64 + F.length("id") + 8 * F.size("spans")), F.lit(0))).first()[0]
    found, body = hit.toDF(*names), F.col(f"`{text}`")
    joined = told.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, names[:3], "left")
    units = F.split(body, WORD_STARTS)
    lead = F.when(F.size(words(F.element_at(units, 1))) == 0, 1).otherwise(0)  # separators before the first word are no word
    inside = lambda i: F.exists(names[3], lambda s: (i - lead >= s["pos"]) & (i - lead < s["end"]))
    cut = F.array_join(F.filter(units, lambda u, i: ~inside(i)), "")
    return joined.select(*[(F.when(F.col(names[3]).isNull(), body).otherwise(cut).alias(c) if c == text else F.col(f"`{c}`")) for c in docs.columns])
