"""Operators on each range alone. Metadata columns, places and order stay; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.expr import minus


def moved(df: DataFrame, start: Column, end: Column) -> DataFrame:
    return df.withColumns({"start": start.cast("int"), "end": end.cast("int")})


def positive(**given: int) -> None:
    for name, value in given.items():
        if value < 0:
            raise ValueError(f"{name} must not be negative")


def plus_or_minus(plus: Column, minus_: Column, ignore_strand: bool) -> Column:
    return plus if ignore_strand else F.when(minus(F.col("strand")), minus_).otherwise(plus)


def shift(df: DataFrame, by: int = 0) -> DataFrame:
    return moved(df, F.col("start") + by, F.col("end") + by)


def narrow(df: DataFrame, start: int | None = None, end: int | None = None, width: int | None = None, validate: bool = True) -> DataFrame:
    """Relative places inside each range, negative ones from its end (-1 is the last base); ``width`` fixes the open side.

    A range that this would widen or turn inside out is an error when it is read (``validate``).
    """
    if width is not None and (start is None) == (end is None):
        raise ValueError("width goes with one of start and end")
    s, e = F.col("start"), F.col("end")
    lo = None if start is None else s + (start - 1) if start > 0 else e + (start + 1)
    hi = None if end is None else s + (end - 1) if end > 0 else e + (end + 1)
    if width is not None:
        lo, hi = (lo, lo + (width - 1)) if lo is not None else (hi - (width - 1), hi)
    lo, hi = s if lo is None else lo, e if hi is None else hi
    if validate:
        bad = (lo < s) | (hi > e) | (hi < lo - 1)
        lo = F.when(bad, F.raise_error(F.lit("narrow would widen or invert a range")).cast("int")).otherwise(lo)
    return moved(df, lo, hi)


def resize(df: DataFrame, width: int, fix: str = "start", ignore_strand: bool = False) -> DataFrame:
    positive(width=width)
    s, e = F.col("start"), F.col("end")
    if fix == "center":
        lo = s + F.floor((e - s + 1 - width) / F.lit(2)).cast("int")
    elif fix in ("start", "end"):
        from_start, from_end = s, e - (width - 1)
        lo = plus_or_minus(*((from_start, from_end) if fix == "start" else (from_end, from_start)), ignore_strand)
    else:
        raise ValueError("fix is start, end or center")
    return moved(df, lo, lo + (width - 1))


def flank(df: DataFrame, width: int, start: bool = True, both: bool = False, ignore_strand: bool = False) -> DataFrame:
    positive(width=width)
    s, e = F.col("start"), F.col("end")
    left, right = (s - width, s + width - 1 if both else s - 1), (e - width + 1 if both else e + 1, e + width)
    first, second = (left, right) if start else (right, left)
    return moved(df, plus_or_minus(first[0], second[0], ignore_strand), plus_or_minus(first[1], second[1], ignore_strand))


def promoters(df: DataFrame, upstream: int = 2000, downstream: int = 200) -> DataFrame:
    positive(upstream=upstream, downstream=downstream)
    s, e = F.col("start"), F.col("end")
    return moved(df, plus_or_minus(s - upstream, e - downstream + 1, False), plus_or_minus(s + downstream - 1, e + upstream, False))


def terminators(df: DataFrame, upstream: int = 2000, downstream: int = 200) -> DataFrame:
    positive(upstream=upstream, downstream=downstream)
    s, e = F.col("start"), F.col("end")
    return moved(df, plus_or_minus(e - upstream, s - downstream + 1, False), plus_or_minus(e + downstream - 1, s + upstream, False))


def clipped(df: DataFrame, low: Column, high: Column) -> DataFrame:
    """Each range cut to [low, high] (null: no bound); one that lies outside becomes empty at the bound it is beyond."""
    s, e = F.col("start"), F.col("end")
    lo, hi = F.greatest(s, low), F.least(e, high)
    beyond_high = s > high
    return moved(df, F.when(hi >= lo - 1, lo).when(beyond_high, high + 1).otherwise(low), F.when(hi >= lo - 1, hi).when(beyond_high, high).otherwise(low - 1))


def trim(df: DataFrame, seqinfo: DataFrame) -> DataFrame:
    """Ranges cut to [1, length] where the length is known and the sequence is not circular.

    ``seqinfo`` holds (seqnames, seqlength, is_circular), one row per sequence: bounded by the sequence dictionary.
    """
    info = seqinfo.where(F.col("seqlength").isNotNull() & ~F.coalesce("is_circular", F.lit(False))).select("seqnames", F.col("seqlength").cast("int").alias("__len"))
    j = df.join(info, "seqnames", "left")
    known = F.col("__len").isNotNull()
    cut = clipped(j, F.when(known, F.lit(1)), F.col("__len"))
    return cut.select(*df.columns)


def restrict(df: DataFrame, start: int | dict | None = None, end: int | dict | None = None, keep_all: bool = False) -> DataFrame:
    """Ranges cut to [start, end]; those without a base inside go unless ``keep_all``. Dicts give bounds by sequence.

    Scalar bounds are also stated on the stored columns, so that they reach the Parquet scan. Empty ranges have no base and go as well.
    """
    if isinstance(start, dict) or isinstance(end, dict):
        names = sorted({*(start if isinstance(start, dict) else ()), *(end if isinstance(end, dict) else ())})
        get = lambda x, n: x.get(n) if isinstance(x, dict) else x
        bounds = F.broadcast(df.sparkSession.createDataFrame([(n, get(start, n), get(end, n)) for n in names], "seqnames string, __lo int, __hi int"))
        j = df.join(bounds, "seqnames", "left")
        low, high = F.col("__lo"), F.col("__hi")
    else:
        j = df
        if not keep_all:
            j = j.where(F.col("end") >= start) if start is not None else j
            j = j.where(F.col("start") <= end) if end is not None else j
        low, high = F.lit(start).cast("int"), F.lit(end).cast("int")
    if not keep_all:
        j = j.where(F.least("end", high) >= F.greatest("start", low))
    return clipped(j, low, high).select(*df.columns)
