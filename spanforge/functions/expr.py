"""Column expressions on 1-based closed intervals (start, end, strand).

A strand is ``+``, ``-`` or ``*``; ``*`` goes with any. A width of zero is written end = start - 1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRANDS = ("+", "-", "*")


def width(start: Column, end: Column) -> Column:
    return end - start + 1


def minus(strand: Column) -> Column:
    """True on the minus strand; ``*`` counts as plus."""
    return strand == "-"


def strand_ok(a: Column, b: Column) -> Column:
    """Two strands can meet: equal, or one of them is ``*``."""
    return (a == b) | (a == "*") | (b == "*")


def compatible(strand: Column) -> Column:
    """The query strands that a subject strand can meet."""
    lists = {"+": ("+", "*"), "-": ("-", "*"), "*": ("+", "-", "*")}
    out = F.array().cast("array<string>")
    for k, v in lists.items():
        out = F.when(strand == k, F.array(*[F.lit(x) for x in v])).otherwise(out)
    return out


def overlap(qs: Column, qe: Column, ss: Column, se: Column, maxgap: int = -1, minoverlap: int = 0) -> Column:
    """A shared base, or a gap of at most ``maxgap`` bases; at least ``minoverlap`` shared bases."""
    g = maxgap + 1
    hit = (qs - g <= se) & (qe + g >= ss)
    return hit & (shared(qs, qe, ss, se) >= minoverlap) if minoverlap > 1 else hit


def shared(qs: Column, qe: Column, ss: Column, se: Column) -> Column:
    return F.least(qe, se) - F.greatest(qs, ss) + 1


def related(kind: str, qs: Column, qe: Column, ss: Column, se: Column, maxgap: int, minoverlap: int) -> Column:
    """The overlap predicate of one kind: any, start, end, within or equal."""
    off = max(maxgap, 0)
    if kind == "any":
        return overlap(qs, qe, ss, se, maxgap, minoverlap)
    rule = {
        "start": F.abs(qs - ss) <= off,
        "end": F.abs(qe - se) <= off,
        "equal": (F.abs(qs - ss) <= off) & (F.abs(qe - se) <= off),
        "within": (qs >= ss) & (qe <= se) & ((qs - ss) + (se - qe) <= off) if maxgap > 0 else (qs >= ss) & (qe <= se),
    }[kind]
    return rule & (shared(qs, qe, ss, se) >= minoverlap) if minoverlap > 0 else rule


def gap_between(xs: Column, xe: Column, ys: Column, ye: Column) -> Column:
    """Bases strictly between two ranges; 0 if they touch or overlap."""
    return F.greatest(F.greatest(xs, ys) - F.least(xe, ye) - 1, F.lit(0))
