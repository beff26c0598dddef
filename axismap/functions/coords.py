"""Coordinates of runs: diagonals, clipping, gaps, group names. Pure Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def diagonal(a: str = "a", b: str = "b", n: str = "len", strand: str = "strand") -> Column:
    """What abutting runs of one line share: b-a forward, a+b+len backward."""
    return F.when(F.col(strand) == 1, F.col(a) + F.col(b) + F.col(n)).otherwise(F.col(b) - F.col(a))


def b_of_diagonal(diag: Column, a: Column, n: Column, strand: Column) -> Column:
    return F.when(strand == 1, diag - a - n).otherwise(diag + a)


def overlaps(start: Column, n: Column, lo: Column, hi: Column) -> Column:
    """Half-open overlap; an empty window overlaps nothing."""
    return (start < hi) & (start + n > lo) & (lo < hi)


def clipped(start: Column, n: Column, across: Column, strand: Column, lo: Column, hi: Column) -> tuple[Column, Column, Column]:
    """(start, start across, length) of what a window leaves of a run.

    ``start`` is on the window's axis and ``across`` on the other; strand 1 takes the
    cut from the other end there.
    """
    first, last = F.greatest(start, lo), F.least(start + n, hi)
    there = F.when(strand == 1, across + (start + n - last)).otherwise(across + (first - start))
    return first, there, last - first


def sign(strand: Column) -> Column:
    return F.when(strand == 1, "-").otherwise("+")


def group_name(name: Column, separator: str, fields: int = 1) -> Column:
    """A name up to its ``fields``-th separator; null if there are fewer, or nothing on either side."""
    parts = F.size(F.split(name, f"\\Q{separator}\\E", -1))
    head = F.substring_index(name, separator, fields)
    whole = (parts > fields) & (F.length(head) > 0) & (F.length(name) > F.length(head) + len(separator))
    return F.when(whole, head)
