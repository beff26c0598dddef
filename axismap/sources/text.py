"""Alignment text into runs: PAF with CIGARs, UCSC chain, BED and TSV.

Spark reads the files (gzip too); parsing is column expressions. Faults are refused
with the line, in one check before runs are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axismap.operators.members import from_sightings
from axismap.operators.ordered import last_mark, numbered
from axismap.schema import RUN_COLUMNS, MapError

MAX_RECORD_PIECE = 1 << 30
BIN = 1 << 20


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line, file and seq (global file order, from 0) of text files.

    Rows are counted within each file block; blocks are put in order by one row each.
    """
    read = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    placed = read.withColumn("row", F.monotonically_increasing_id())
    return numbered(placed, ["file", "block"], ["row"], "seq", start=0).select("line", "file", "seq")


def _number(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))


def _faults(df: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """line and fault of the rows that break one of ``rules`` (the first that holds)."""
    found = F.coalesce(*[F.when(fault, F.lit(what)) for fault, what in rules])
    return df.select("line", found.alias("fault")).filter("fault is not null")


def _refuse(*faults: DataFrame) -> None:
    """Raise for any faulty line, found in one job."""
    bad = reduce(DataFrame.union, faults).limit(1).collect()
    if bad:
        raise MapError(f"{bad[0]['fault']}: {bad[0]['line'][:200]!r}")


def _assemble(blocks: DataFrame, seen: DataFrame, swap: bool) -> tuple[DataFrame, DataFrame]:
    """(runs, members) from blocks with names, and sightings of names with lengths."""
    flip = {"a": "b", "b": "a"}
    if swap:
        blocks = blocks.select(*[F.col({"a_name": "b_name", "b_name": "a_name", "a": "b", "b": "a"}.get(c, c)).alias(c) for c in ("a_name", "a", "b_name", "b", "len", "strand")])
        seen = seen.withColumn("axis", F.when(F.col("axis") == "a", flip["a"]).otherwise(flip["b"]))
    members = from_sightings(seen).persist()
    for axis in ("a", "b"):
        ids = members.filter(F.col("axis") == axis).select(F.col("name").alias(f"{axis}_name"), F.col("member_id").alias(f"{axis}_member"))
        blocks = blocks.join(ids, f"{axis}_name")
    # kept: checks, ids and the canonical form each read what was parsed
    return blocks.filter("len > 0").select(*RUN_COLUMNS).persist(), members


def paf(text: DataFrame, swap: bool = False) -> tuple[DataFrame, DataFrame]:
    """(runs, members) of PAF lines (line, seq): query on axis a, target on axis b.

    Every line needs a cg:Z: tag of M, =, X, I, D and N that spans its intervals. The
    target is walked forward, the query backward on strand -.
    """
    rows = text.filter(~F.col("line").rlike(r"^\s*$") & ~F.col("line").startswith("#"))
    f = F.split("line", "\t", -1)
    names = ["qname", "qlen", "qs", "qe", "strand", "tname", "tlen", "ts", "te"]
    p = rows.select("line", "seq", F.size(f).alias("n"), *[F.get(f, F.lit(i)).alias(c) for i, c in enumerate(names)], F.get(F.filter(F.slice(f, 13, 1 << 20), lambda x: x.startswith("cg:Z:")), F.lit(0)).alias("tag"))
    for c in ("qlen", "qs", "qe", "tlen", "ts", "te"):
        p = p.withColumn(c, _number(F.col(c)))
    p = p.withColumn("cigar", F.substring("tag", 6, MAX_RECORD_PIECE))
    ops = F.transform(F.regexp_extract_all("cigar", F.lit(r"(\d+\D)"), 1), lambda x: F.struct(F.regexp_extract(x, r"^\d+", 0).try_cast("bigint").alias("n"), F.right(x, F.lit(1)).alias("op")))
    p = p.withColumn("ops", F.filter(ops, lambda o: o["n"] > 0)).persist()
    on_q = lambda o: F.when(o["op"].isin("M", "=", "X", "I"), o["n"]).otherwise(0)
    on_t = lambda o: F.when(o["op"].isin("M", "=", "X", "D", "N"), o["n"]).otherwise(0)
    fine = (F.col("qs") >= 0) & (F.col("qs") <= F.col("qe")) & (F.col("qe") <= F.col("qlen")) & (F.col("ts") >= 0) & (F.col("ts") <= F.col("te")) & (F.col("te") <= F.col("tlen"))
    total = lambda side: F.aggregate("ops", F.lit(0).cast("bigint"), lambda s, o: s + side(o))
    _refuse(_faults(p, [
        (F.col("n") < 12, "a PAF line needs 12 columns"),
        (~F.coalesce(fine, F.lit(False)) | ~F.col("strand").isin("+", "-"), "bad coordinates or strand in a PAF line"),
        (F.col("tag").isNull(), "a PAF line without a cg:Z: CIGAR"),
        (~F.col("cigar").rlike(r"^(?:\d+[MX=IDN]|0+.)*$"), "a CIGAR operation that is not M, =, X, I, D or N"),
        ((total(on_q) != F.col("qe") - F.col("qs")) | (total(on_t) != F.col("te") - F.col("ts")), "a CIGAR that does not span its intervals"),
    ]))
    ex = p.select("qname", "tname", "strand", "qs", "qe", "ts", "seq", F.posexplode("ops").alias("pos", "o"))
    upto = Window.partitionBy("seq").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    ex = ex.withColumn("dq", F.coalesce(F.sum(on_q(F.col("o"))).over(upto), F.lit(0))).withColumn("dt", F.coalesce(F.sum(on_t(F.col("o"))).over(upto), F.lit(0)))
    rev = F.col("strand") == "-"
    blocks = ex.filter(F.col("o.op").isin("M", "=", "X")).select(
        F.col("qname").alias("a_name"), F.when(rev, F.col("qe") - F.col("dq") - F.col("o.n")).otherwise(F.col("qs") + F.col("dq")).alias("a"),
        F.col("tname").alias("b_name"), (F.col("ts") + F.col("dt")).alias("b"), F.col("o.n").alias("len"), rev.cast("int").alias("strand"),
    )
    seen = p.select(F.lit("a").alias("axis"), F.col("qname").alias("name"), F.col("qlen").alias("length"), "seq").union(p.select(F.lit("b"), "tname", "tlen", "seq"))
    return _assemble(blocks, seen, swap)


def ucsc_chain(text: DataFrame, swap: bool = False) -> tuple[DataFrame, DataFrame]:
    """(runs, members) of UCSC chain lines (line, file, seq): target on axis a, query on b.

    Each side's coordinates are on its own strand; the strand of a run is whether they
    differ. A line belongs to the latest header before it in its file, which is carried
    over bins of lines, so that a long file is not one task.
    """
    body = text.filter(~F.col("line").startswith("#"))
    head = F.col("line").startswith("chain")
    body = body.withColumn("bin", F.floor(F.col("seq") / BIN))
    body = last_mark(body, ["file"], "bin", ["seq"], F.when(head, F.col("seq")), "number").persist()
    outside = _faults(body, [(F.expr("number is null and trim(line) != ''"), "data outside a chain")])
    h = F.split(F.trim("line"), r"[ \t]+")
    names = ["tname", "tsize", "tstrand", "tstart", "tend", "qname", "qsize", "qstrand", "qstart", "qend"]
    heads = body.filter(head).select("file", "number", "seq", "line", F.size(h).alias("n"), *[F.get(h, F.lit(i + 2)).alias(c) for i, c in enumerate(names)])
    for c in ("tsize", "tstart", "tend", "qsize", "qstart", "qend"):
        heads = heads.withColumn(c, _number(F.col(c)))
    heads = heads.persist()
    fine = F.col("tstrand").isin("+", "-") & F.col("qstrand").isin("+", "-") & (F.col("tstart") >= 0) & (F.col("tend") <= F.col("tsize")) & (F.col("qstart") >= 0) & (F.col("qend") <= F.col("qsize"))
    bad_heads = _faults(heads, [(F.col("n") < 12, "a chain header needs 12 fields"), (~F.coalesce(fine, F.lit(False)), "bad coordinates or strand in a chain header")])
    d = F.split(F.trim("line"), r"[ \t]+")
    # a blank line ends nothing: inside a chain it is refused
    after = Window.partitionBy("file", "number").orderBy("seq")
    blank = body.withColumn("open", F.lag(F.size(F.split(F.trim("line"), r"[ \t]+"))).over(after))
    blanks = _faults(blank, [(F.expr("trim(line) = '' and open != 1"), "a blank line inside a chain")])
    data = body.filter(~head & (F.trim("line") != "")).select("file", "number", "seq", "line", F.size(d).alias("n"), *[_number(F.get(d, F.lit(i))).alias(c) for i, c in enumerate(("size", "dt", "dq"))])
    data = data.persist()
    bad = F.col("size").isNull() | (F.col("size") < 0) | ((F.col("n") != 1) & ((F.col("n") != 3) | F.col("dt").isNull() | F.col("dq").isNull() | (F.col("dt") < 0) | (F.col("dq") < 0)))
    bad_data = _faults(data, [(bad, "a bad chain line")])
    inside = Window.partitionBy("file", "number").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    step = data.withColumn("pt", F.coalesce(F.sum(F.col("size") + z("dt")).over(inside), F.lit(0))).withColumn("pq", F.coalesce(F.sum(F.col("size") + z("dq")).over(inside), F.lit(0)))
    ends = data.groupBy("file", "number").agg(F.sum(F.col("size") + z("dt")).alias("all_t"), F.sum(F.col("size") + z("dq")).alias("all_q"), F.sum((F.col("n") == 1).cast("int")).alias("closers"), F.max_by("n", "seq").alias("last_n"))
    whole = heads.join(ends, ["file", "number"], "left")
    spans = (F.col("closers") == 1) & (F.col("last_n") == 1) & (F.col("tstart") + F.col("all_t") == F.col("tend")) & (F.col("qstart") + F.col("all_q") == F.col("qend"))
    cut_off = _faults(whole, [(~F.coalesce(spans, F.lit(False)), "a chain that is not closed or does not reach its ends")])
    _refuse(outside, bad_heads, blanks, bad_data, cut_off)
    x = step.select("file", "number", "size", "pt", "pq").join(heads.drop("seq", "line", "n"), ["file", "number"])
    t, q = F.col("tstart") + F.col("pt"), F.col("qstart") + F.col("pq")
    blocks = x.select(
        F.col("tname").alias("a_name"), F.when(F.col("tstrand") == "-", F.col("tsize") - t - F.col("size")).otherwise(t).alias("a"),
        F.col("qname").alias("b_name"), F.when(F.col("qstrand") == "-", F.col("qsize") - q - F.col("size")).otherwise(q).alias("b"),
        F.col("size").alias("len"), (F.col("tstrand") != F.col("qstrand")).cast("int").alias("strand"),
    )
    seen = heads.select(F.lit("a").alias("axis"), F.col("tname").alias("name"), F.col("tsize").alias("length"), "seq").union(heads.select(F.lit("b"), "qname", "qsize", "seq"))
    return _assemble(blocks, seen, swap)


def bed(text: DataFrame) -> DataFrame:
    """query_id, name, lo, hi and the other columns (``rest``) of BED lines."""
    rows = text.filter(~F.col("line").rlike(r"^\s*$") & ~F.col("line").rlike("^(#|track|browser)"))
    f = F.split("line", "\t", 64)
    b = rows.select("line", F.col("seq").alias("query_id"), F.size(f).alias("n"), F.get(f, F.lit(0)).alias("name"), _number(F.get(f, F.lit(1))).alias("lo"), _number(F.get(f, F.lit(2))).alias("hi"), F.slice(f, 4, 64).alias("rest"))
    fine = (F.col("n") >= 3) & (F.col("lo") >= 0) & (F.col("lo") <= F.col("hi"))
    _refuse(_faults(b, [(~F.coalesce(fine, F.lit(False)), "a bad BED line")]))
    return b.select("query_id", "name", "lo", "hi", "rest")


def bed_lines(lifted: DataFrame, intervals: DataFrame, members: DataFrame, axis: str) -> DataFrame:
    """BED lines of lifted results: place, then the columns of the source row, column 6 flipped on strand 1."""
    named = lifted.join(members.filter(F.col("axis") == axis).select(F.col("member_id").alias("member"), F.col("name").alias("t_name")), "member")
    x = named.join(intervals.select("query_id", "rest"), "query_id")
    turned = F.transform("rest", lambda v, i: F.when((i == 2) & (F.col("strand") == 1) & v.isin("+", "-"), F.translate(v, "+-", "-+")).otherwise(v))
    return x.orderBy("query_id", "src_start").select("query_id", F.array_join(F.concat(F.array("t_name", F.col("start").cast("string"), F.col("end").cast("string")), turned), "\t").alias("text"))
