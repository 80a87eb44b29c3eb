"""Operators on x[i] and y[i], paired by place. Sequence and strand are those of x; metadata go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.expr import gap_between, strand_ok


def paired(x: DataFrame, y: DataFrame, validate: bool = True) -> DataFrame:
    """rid, both sequences, strands, starts and ends. A place without partner is an error when its rid is read."""
    a = x.select("rid", "seqnames", "strand", F.col("start").alias("xs"), F.col("end").alias("xe"))
    b = y.select("rid", F.col("seqnames").alias("ysq"), F.col("strand").alias("yst"), F.col("start").alias("ys"), F.col("end").alias("ye"))
    j = a.join(b, "rid", "full" if validate else "inner")
    if validate:
        lone = F.col("xs").isNull() | F.col("ys").isNull()
        j = j.withColumn("rid", F.when(lone, F.raise_error(F.lit("x and y differ in length")).cast("long")).otherwise(F.col("rid")))
    return j


def together(j: DataFrame, ignore_strand: bool, strict: bool = False) -> Column:
    same = F.col("seqnames") == F.col("ysq")
    if ignore_strand:
        return same
    return same & ((F.col("strand") == F.col("yst")) if strict else strand_ok(F.col("strand"), F.col("yst")))


def checked(value: Column, bad: Column, message: str) -> Column:
    return F.when(bad, F.raise_error(F.lit(message)).cast("int")).otherwise(value)


def made(j: DataFrame, start: Column, end: Column) -> DataFrame:
    return j.select("rid", "seqnames", start.cast("int").alias("start"), end.cast("int").alias("end"), "strand")


def punion(x: DataFrame, y: DataFrame, fill_gap: bool = False, ignore_strand: bool = False) -> DataFrame:
    j = paired(x, y)
    bad = ~together(j, ignore_strand)
    if not fill_gap:
        bad = bad | (F.greatest("xs", "ys") > F.least("xe", "ye") + 1)
    lo = checked(F.least("xs", "ys"), bad, "a pair cannot be united: other sequence or strand, or a gap between")
    return made(j, lo, F.greatest("xe", "ye"))


def pintersect(x: DataFrame, y: DataFrame, drop_nohit: bool = False, ignore_strand: bool = False, strict_strand: bool = False) -> DataFrame:
    """The common part; pairs without one get an empty range at the start of x, or go."""
    j = paired(x, y)
    lo, hi = F.greatest("xs", "ys"), F.least("xe", "ye")
    hit = together(j, ignore_strand, strict_strand) & (hi >= lo)
    if drop_nohit:
        return made(j.where(hit), lo, hi)
    return made(j, F.when(hit, lo).otherwise(F.col("xs")), F.when(hit, hi).otherwise(F.col("xs") - 1))


def psetdiff(x: DataFrame, y: DataFrame, ignore_strand: bool = False) -> DataFrame:
    """x without y; an error where y lies strictly inside x, as two parts would be left."""
    j = paired(x, y)
    xs, xe, ys, ye = (F.col(c) for c in ("xs", "xe", "ys", "ye"))
    meet = together(j, ignore_strand) & (ys <= xe) & (ye >= xs) & (ye >= ys)
    cover, left = (ys <= xs) & (ye >= xe), ys <= xs
    lo = checked(F.when(meet & ~cover & left, ye + 1).otherwise(xs), meet & (ys > xs) & (ye < xe), "y lies inside x: two ranges would be left")
    return made(j, lo, F.when(meet & cover, xs - 1).when(meet & ~left, ys - 1).otherwise(xe))


def pgap(x: DataFrame, y: DataFrame, ignore_strand: bool = False) -> DataFrame:
    """The gap between the two, empty if they touch or overlap."""
    j = paired(x, y)
    lo = checked(F.least("xe", "ye") + 1, ~together(j, ignore_strand), "a pair is on other sequences or strands")
    return made(j, lo, F.greatest(F.greatest("xs", "ys") - 1, F.least("xe", "ye")))


def distance(x: DataFrame, y: DataFrame, ignore_strand: bool = False) -> DataFrame:
    """(rid, distance): bases between the two, null where they cannot meet."""
    j = paired(x, y)
    return j.select("rid", F.when(together(j, ignore_strand), gap_between(*(F.col(c) for c in ("xs", "xe", "ys", "ye")))).alias("distance"))
