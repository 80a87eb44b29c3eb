"""Merging and sweeping: range, reduce, disjoin, gaps, coverage, union, intersect, setdiff.

Strand is a space of its own here: ``*`` meets only ``*``, unless strands are ignored, when all ranges share
``*``. Metadata go. Events are summed per position before they are shuffled, and sequences are split
into bins (see ``plans.scan``), so neither a deep position nor a long sequence is one task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce as fold
from numbers import Integral, Real

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.operators.overlaps import overlap_pairs
from spanforge.plans.scan import WIDTH, asked_bins, bin_of, next_by_bin, running, runs, upto

GROUP = ["seqnames", "strand"]


def spaced(df: DataFrame, ignore_strand: bool) -> DataFrame:
    return df.select("seqnames", (F.lit("*") if ignore_strand else F.col("strand")).alias("strand"), "start", "end")


def shaped(df: DataFrame, start: Column, end: Column) -> DataFrame:
    return df.select("seqnames", start.cast("int").alias("start"), end.cast("int").alias("end"), "strand")


def span(df: DataFrame, ignore_strand: bool = False) -> DataFrame:
    """The least start and greatest end of each sequence and strand."""
    return shaped(spaced(df, ignore_strand).groupBy(*GROUP).agg(F.min("start").alias("lo"), F.max("end").alias("hi")), F.col("lo"), F.col("hi"))


def reduce(df: DataFrame, min_gapwidth: int = 1, drop_empty: bool = False, ignore_strand: bool = False, width: int = WIDTH) -> DataFrame:
    """Ranges that overlap, touch, or lie less than ``min_gapwidth`` apart become one: stretches of some depth, each range prolonged by that much."""
    if min_gapwidth < 0:
        raise ValueError("min_gapwidth must not be negative")
    if not min_gapwidth:
        out = chained(df, ignore_strand, width)
        return out.where("end >= start") if drop_empty else out
    # Starts at even places and ends at odd ones, so that a range that ends where another starts never cancels it.
    rows = spaced(df, ignore_strand)
    ends = F.explode(F.array(F.struct((2 * F.col("start").cast("long")).alias("pos"), F.lit(1).alias("n")), F.struct((2 * (F.col("end").cast("long") + min_gapwidth) + 1).alias("pos"), F.lit(-1).alias("n"))))
    changes = rows.select(*GROUP, ends.alias("e")).select(*GROUP, "e.*").groupBy(*GROUP, "pos").agg(F.sum("n").alias("n")).where("n <> 0")
    out = runs(changes, GROUP, ["n"], lambda d: d[0] > 0, 2 * width)
    out = shaped(out, (F.col("lo") / 2), (F.col("hi") / 2 - min_gapwidth))
    return out.where("end >= start") if drop_empty else out


def reduce_links(df: DataFrame, min_gapwidth: int = 1, ignore_strand: bool = False, width: int = WIDTH) -> DataFrame:
    """(seqnames, start, end, strand, member): each range of :func:`reduce` and the places of the ranges that it was made from, a row per link.

    Every range lies in one result, the last that starts no later than it, which is looked up among the starts of its bin: links are neither
    gathered into arrays nor found by pairs. ``min_gapwidth`` is 1 at least, where no two results start at one place.
    """
    if min_gapwidth < 1:
        raise ValueError("links need a min_gapwidth of 1 at least")
    made = reduce(df, min_gapwidth, False, ignore_strand, width)
    # The last start up to a place is the first one beyond it on mirrored coordinates.
    known = made.select(*GROUP, (-F.col("start").cast("long")).alias("pos"), "end")
    asks = df.select("seqnames", (F.lit("*") if ignore_strand else F.col("strand")).alias("strand"), F.col("rid").alias("member"), (-F.col("start").cast("long") - 1).alias("ask")).withColumn("__bin", bin_of(F.col("ask"), width))
    bins = next_by_bin(known, asked_bins(asks, GROUP), GROUP, ["end"], width)
    found = asks.join(bins, [*GROUP, "__bin"]).withColumn("k", upto(F.col("places"), F.col("ask")))
    pick = lambda array, of: F.when(F.coalesce(F.col("k") < F.size("places"), F.lit(False)), F.get(array, F.col("k"))).otherwise(F.col(f"after.{of}"))
    return found.select("seqnames", (-pick("places", "pos")).cast("int").alias("start"), pick("end", "end").alias("end"), "strand", "member")


def disjoin_links(df: DataFrame, ignore_strand: bool = False, width: int = WIDTH) -> DataFrame:
    """(seqnames, start, end, strand, member): each range of :func:`disjoin` and the places of the ranges that cover it, a row per link; by the join of overlaps inside each strand."""
    pieces = disjoin(df, ignore_strand, width)
    space = F.struct("seqnames", "strand").alias("seqnames")
    a = df.where("end >= start").select("rid", "seqnames", (F.lit("*") if ignore_strand else F.col("strand")).alias("strand"), "start", "end")
    # A piece names itself by its coordinates: no places are dealt.
    b = pieces.select(F.struct("seqnames", "start", "end", "strand").alias("rid"), "seqnames", "strand", "start", "end")
    pairs = overlap_pairs(a.select("rid", space, "start", "end", "strand"), b.select("rid", space, "start", "end", "strand"), ignore_strand=True)
    return pairs.select("subject_idx.*", F.col("query_idx").alias("member"))


def chained(df: DataFrame, ignore_strand: bool, width: int) -> DataFrame:
    """Ranges that share a base become one; empty ranges only join what covers their start."""
    # Of ranges with one start only the longest can matter; empty ones are merged by their own rule.
    rows = spaced(df, ignore_strand).groupBy(*GROUP, "start", (F.col("end") >= F.col("start")).alias("full")).agg(F.max("end").alias("end"))
    seen = running(rows, GROUP, "start", {"reach": ("max", "end")}, then=["full"], before=True, width=width)
    first = F.col("reach").isNull() | (F.col("start") > F.col("reach"))
    heads = seen.withColumn("head", F.when(first, F.struct("start", "full")))
    named = running(heads, GROUP, "start", {"cluster": ("max", "head")}, then=["full"], width=width)
    out = named.groupBy(*GROUP, "cluster").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    return shaped(out, F.col("lo"), F.col("hi"))


def events(df: DataFrame, weights: dict[str, Column], lo: Column | None = None, hi: Column | None = None) -> DataFrame:
    """(seqnames, strand, pos, weights): each range adds its weights at its start and takes them back behind its end."""
    lo, hi = F.col("start") if lo is None else lo, F.col("end") if hi is None else hi
    rows = df.where("end >= start")
    ends = F.explode(F.array(F.struct(lo.cast("long").alias("pos"), *[w.alias(n) for n, w in weights.items()]), F.struct((hi.cast("long") + 1).alias("pos"), *[(-w).alias(n) for n, w in weights.items()])))
    flat = rows.select("seqnames", "strand", ends.alias("e")).select("seqnames", "strand", "e.*")
    return flat.groupBy(*GROUP, "pos").agg(*[F.sum(n).alias(n) for n in weights])


def pieces(changes: DataFrame, names: list[str], width: int = WIDTH) -> DataFrame:
    """(…, pos, upto, depth_<name>): stretches between neighbouring positions with their running sums."""
    out = running(changes, GROUP, "pos", {f"depth_{n}": ("sum", n) for n in names}, following="next", width=width)
    return out.where("next is not null").withColumn("upto", F.col("next") - 1)


def disjoin(df: DataFrame, ignore_strand: bool = False, width: int = WIDTH) -> DataFrame:
    """Covered stretches, cut at every start and behind every end."""
    out = pieces(events(spaced(df, ignore_strand), {"n": F.lit(1)}), ["n"], width).where("depth_n > 0")
    return shaped(out, F.col("pos"), F.col("upto"))


def by_sequence(df: DataFrame, given: int | dict[str, int] | None, name: str, fallback: Column) -> DataFrame:
    """``df`` with a column of one parameter: the number given, that of the row's sequence, or ``fallback`` where there is none.

    Numbers by sequence are a table that joins on the sequence, as small as what was given.
    """
    if not isinstance(given, dict):
        return df.withColumn(name, (fallback if given is None else F.lit(given)).cast("long"))
    table = df.sparkSession.createDataFrame(list(given.items()), "seqnames string, __given long")
    return df.join(table, "seqnames", "left").withColumn(name, F.coalesce("__given", fallback).cast("long")).drop("__given")


def bounds_of(df: DataFrame, seqinfo: DataFrame, start: int | dict, end: dict | int | None) -> DataFrame:
    """(seqnames, lo, hi) of the sequences whose bounds are known and in order; as small as the sequence dictionary."""
    rows = by_sequence(seqinfo.select("seqnames", "seqlength"), start, "lo", F.lit(None) if isinstance(start, dict) else F.lit(1))
    rows = by_sequence(rows, end, "hi", F.lit(None) if isinstance(end, dict) else F.col("seqlength"))
    return rows.where("lo is not null and hi is not null and hi >= lo").select("seqnames", "lo", "hi")


def gaps(df: DataFrame, seqinfo: DataFrame, start: int | dict = 1, end: int | dict | None = None, ignore_strand: bool = False, width: int = WIDTH) -> DataFrame:
    """Uncovered stretches inside the bounds of each sequence, for each strand (``*`` alone if strands are ignored).

    Every strand of every bounded sequence counts, ranges or none. Sequences of unknown length have no gaps.
    """
    bounds = bounds_of(df, seqinfo, start, end).withColumn("strand", F.explode(F.array(*[F.lit(x) for x in (("*",) if ignore_strand else ("+", "-", "*"))])))
    marks = bounds.select("seqnames", "strand", F.explode(F.array("lo", F.col("hi") + 1)).alias("pos"), F.lit(0).cast("long").alias("n"))
    changes = events(spaced(df, ignore_strand), {"n": F.lit(1)}).where("n <> 0").select("seqnames", "strand", "pos", "n")
    every = changes.unionByName(marks).groupBy(*GROUP, "pos").agg(F.sum("n").alias("n"))
    out = pieces(every, ["n"], width).where("depth_n = 0").join(bounds, GROUP)
    lo, hi = F.greatest("pos", "lo"), F.least("upto", "hi")
    return shaped(out.where(hi >= lo), lo, hi)


def coverage(df: DataFrame, seqinfo: DataFrame, shift: int | dict[str, int] = 0, width: int | dict | None = None, weight: float = 1, scan_width: int = WIDTH) -> DataFrame:
    """Runs of equal depth: (seqnames, start, end, width, depth), from base 1 to the width of each sequence.

    Strands are ignored. ``shift`` and ``width`` are a number, or numbers by sequence (others are not shifted, or have their own length). Shifted ranges are cut at base
    1 and dropped if nothing is left. The width of a sequence is its length, else as far as its ranges reach. Whole weights give whole depths.
    """
    if isinstance(weight, bool) or not isinstance(weight, Real):
        raise ValueError("weight is one number")
    whole = isinstance(weight, Integral)
    w = F.lit(int(weight) if whole else float(weight)).cast("long" if whole else "double")
    moved = by_sequence(spaced(df, True), shift, "__shift", F.lit(0)).withColumns({c: F.col(c).cast("long") + F.col("__shift") for c in ("start", "end")})
    changes = events(moved.where("end >= 1 and end >= start"), {"n": w}, F.greatest("start", F.lit(1)), F.col("end")).where("n <> 0")
    ends = by_sequence(seqinfo.select("seqnames", "seqlength"), width, "hi", F.col("seqlength")).select("seqnames", F.lit("*").alias("strand"), "hi")
    marks = ends.select("seqnames", "strand", F.explode(F.when(F.col("hi").isNull(), F.array(F.lit(1).cast("long"))).otherwise(F.array(F.lit(1).cast("long"), F.col("hi") + 1))).alias("pos"), F.lit(0).cast(changes.schema["n"].dataType).alias("n"))
    every = changes.unionByName(marks).groupBy(*GROUP, "pos").agg(F.sum("n").alias("n"))
    out = pieces(every, ["n"], scan_width).join(ends, GROUP)
    out = out.where("hi is null or pos <= hi")
    stop = F.least("upto", "hi")
    return out.select("seqnames", F.col("pos").cast("int").alias("start"), stop.cast("int").alias("end"), (stop - F.col("pos") + 1).cast("int").alias("width"), F.col("depth_n").alias("depth"))


def union(*frames: DataFrame, ignore_strand: bool = False, width: int = WIDTH) -> DataFrame:
    return reduce(fold(DataFrame.unionByName, [spaced(f, ignore_strand) for f in frames]), drop_empty=True, ignore_strand=ignore_strand, width=width)


def combined(x: DataFrame, y: DataFrame, keep: Callable[[list[Column]], Column], ignore_strand: bool, width: int) -> DataFrame:
    """The longest stretches where ``keep`` holds of the depths of both sides; one sweep, no join."""
    one, zero = F.lit(1), F.lit(0)
    both = events(spaced(x, ignore_strand), {"x": one, "y": zero}).unionByName(events(spaced(y, ignore_strand), {"x": zero, "y": one}))
    changes = both.groupBy(*GROUP, "pos").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return shaped(runs(changes, GROUP, ["x", "y"], keep, width), F.col("lo"), F.col("hi"))


def intersect(x: DataFrame, y: DataFrame, ignore_strand: bool = False, width: int = WIDTH) -> DataFrame:
    return combined(x, y, lambda d: (d[0] > 0) & (d[1] > 0), ignore_strand, width)


def setdiff(x: DataFrame, y: DataFrame, ignore_strand: bool = False, width: int = WIDTH) -> DataFrame:
    return combined(x, y, lambda d: (d[0] > 0) & (d[1] == 0), ignore_strand, width)
