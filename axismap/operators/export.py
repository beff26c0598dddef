"""Alignment records: consecutive runs of an a member joined over small gaps, as PAF or chain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axismap.functions.coords import sign
from axismap.operators.ordered import last_mark, numbered, previous_row
from axismap.schema import as_runs

BIN = 1 << 20
MAX_GAP = 10_000


def records(runs: DataFrame, members: DataFrame, max_gap: int = MAX_GAP, bin_width: int = BIN) -> DataFrame:
    """A row per record: id, names and lengths, extents, strand and blocks.

    A run goes on the record of the run just before it in its a member (in order of a,
    b member, b, len, strand) if the b member and strand are the same and both gaps lie
    in [0, max_gap]; any other run between them ends the record. Ids count from 1 over
    a members in name order. ``blocks`` are the runs in order of a.
    """
    order = ["a", "b_member", "b", "len", "strand"]
    r = as_runs(runs).withColumn("bin", F.floor(F.col("a") / bin_width))
    r = previous_row(r, ["a_member"], "bin", order, order)
    ga = F.col("a") - F.col("prev.a") - F.col("prev.len")
    gb = F.when(F.col("strand") == 1, F.col("prev.b") - F.col("b") - F.col("len")).otherwise(F.col("b") - F.col("prev.b") - F.col("prev.len"))
    same = (F.col("b_member") == F.col("prev.b_member")) & (F.col("strand") == F.col("prev.strand"))
    goes_on = F.coalesce(same & ga.between(0, max_gap) & gb.between(0, max_gap), F.lit(False))
    r = last_mark(r, ["a_member"], "bin", order, F.when(~goes_on, F.struct(*order)), "head")
    rec = r.groupBy("a_member", "head").agg(
        F.min("a").alias("a0"), F.max(F.col("a") + F.col("len")).alias("a1"), F.min("b").alias("b0"), F.max(F.col("b") + F.col("len")).alias("b1"),
        F.sum("len").alias("matched"), F.array_sort(F.collect_list(F.struct("a", "b", "len"))).alias("blocks"),
    ).select("*", F.col("head.b_member").alias("b_member"), F.col("head.strand").alias("strand"))
    for axis in ("a", "b"):
        m = members.filter(F.col("axis") == axis).select(F.col("member_id").alias(f"{axis}_member"), F.col("name").alias(f"{axis}_name"), F.col("length").alias(f"{axis}_length"))
        rec = rec.join(m, f"{axis}_member")
    heads = [F.col(f"head.{c}") for c in order]
    return numbered(rec, ["a_name"], heads, "id", bin_=F.floor(F.col("head.a") / bin_width)).drop("head", "a_member", "b_member")


def _gaps(strand: Column) -> Column:
    """Blocks but the last with what follows each: len, gap on a, gap on b."""
    return F.transform(
        F.sequence(F.lit(1), F.size("blocks") - 1),
        lambda i: F.struct(
            F.col("blocks")[i - 1]["len"].alias("len"), (F.col("blocks")[i]["a"] - F.col("blocks")[i - 1]["a"] - F.col("blocks")[i - 1]["len"]).alias("ga"),
            F.when(strand == 1, F.col("blocks")[i - 1]["b"] - F.col("blocks")[i]["b"] - F.col("blocks")[i]["len"]).otherwise(F.col("blocks")[i]["b"] - F.col("blocks")[i - 1]["b"] - F.col("blocks")[i - 1]["len"]).alias("gb"),
        ),
    )


def _with_gaps(rec: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<len:bigint,ga:bigint,gb:bigint>>")
    return rec.withColumn("gaps", F.when(F.size("blocks") > 1, _gaps(F.col("strand"))).otherwise(none)).withColumn("last", F.element_at("blocks", -1)["len"])


def chain_text(rec: DataFrame) -> DataFrame:
    """id and text: a UCSC chain per record, axis a the target; q on its own strand."""
    r = _with_gaps(rec)
    rev = F.col("strand") == 1
    q0 = F.when(rev, F.col("b_length") - F.col("b1")).otherwise(F.col("b0"))
    q1 = F.when(rev, F.col("b_length") - F.col("b0")).otherwise(F.col("b1"))
    head = F.concat_ws(" ", F.lit("chain"), "matched", "a_name", "a_length", F.lit("+"), "a0", "a1", "b_name", "b_length", sign(F.col("strand")), q0, q1, "id")
    lines = F.transform("gaps", lambda g: F.concat_ws("\t", g["len"], g["ga"], g["gb"]))
    return r.select("id", F.concat(F.array_join(F.concat(F.array(head), lines, F.array(F.col("last").cast("string"))), "\n"), F.lit("\n\n")).alias("text"))


def paf_text(rec: DataFrame) -> DataFrame:
    """id and text: a PAF line per record, axis a the query, with a CIGAR along the target."""
    r = _with_gaps(rec)
    op = lambda n, letter: F.when(n > 0, F.concat(n.cast("string"), F.lit(letter))).otherwise("")
    # forward: block, then the gap after it; backward the target runs from the last block to the first
    forward = F.concat(F.array_join(F.transform("gaps", lambda g: F.concat(op(g["len"], "M"), op(g["ga"], "I"), op(g["gb"], "D"))), ""), op(F.col("last"), "M"))
    backward = F.concat(op(F.col("last"), "M"), F.array_join(F.transform(F.reverse("gaps"), lambda g: F.concat(op(g["ga"], "I"), op(g["gb"], "D"), op(g["len"], "M"))), ""))
    cigar = F.when(F.col("strand") == 1, backward).otherwise(forward)
    block = F.col("a1") - F.col("a0") + F.col("b1") - F.col("b0") - F.col("matched")
    line = F.concat_ws("\t", "a_name", "a_length", "a0", "a1", sign(F.col("strand")), "b_name", "b_length", "b0", "b1", "matched", block, F.lit(255), F.concat(F.lit("cg:Z:"), cigar))
    return r.select("id", line.alias("text"))


def dump(runs: DataFrame, members: DataFrame) -> DataFrame:
    """a_name, a, b_name, b, len, strand (+ or -), a members in name order."""
    r = as_runs(runs)
    for axis in ("a", "b"):
        r = r.join(members.filter(F.col("axis") == axis).select(F.col("member_id").alias(f"{axis}_member"), F.col("name").alias(f"{axis}_name")), f"{axis}_member")
    return r.orderBy("a_name", "a", "b_member", "b", "len", "strand").select("a_name", "a", "b_name", "b", "len", sign(F.col("strand")).alias("strand"))
