"""Grouped ranges: one row per group, coordinates as arrays of equal length, metadata per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARRAYS = ["seqnames", "start", "end", "strand"]


def bind_list(df: DataFrame, key: str, *, seqnames: str, start: str | None = None, end: str | None = None, width: str | None = None, strand: str | None = None, mcols: list[str] | None = None) -> DataFrame:
    """key, the four arrays, metadata; two of start, end and width are needed. Without a strand all are ``*``."""
    if sum(x is not None for x in (start, end, width)) != 2:
        raise ValueError("give exactly two of start, end and width")
    a = F.col(start) if start else F.zip_with(end, width, lambda e, w: e - w + 1)
    b = F.col(end) if end else F.zip_with(start, width, lambda s, w: s + w - 1)
    x = F.col(strand) if strand else F.transform(seqnames, lambda _: F.lit("*"))
    return df.select(key, F.col(seqnames).alias("seqnames"), a.cast("array<int>").alias("start"), b.cast("array<int>").alias("end"), x.alias("strand"), *(mcols or []))


def split(df: DataFrame, by: str) -> DataFrame:
    """Flat ranges to groups, in the order of their places."""
    rows = F.sort_array(F.collect_list(F.struct("rid", *ARRAYS)))
    grouped = df.groupBy(by).agg(rows.alias("r"))
    return grouped.select(by, *[part("r", c) for c in ARRAYS])


def part(rows: str, name: str) -> Column:
    """One field of an array of structs, as an array of its own name."""
    return F.transform(rows, lambda x: x[name]).alias(name)


def unlist(df: DataFrame, key: str) -> DataFrame:
    """(key, part, seqnames, start, end, strand), part from 1."""
    out = df.select(key, F.posexplode(F.arrays_zip(*ARRAYS)).alias("part", "r"))
    return out.select(key, (F.col("part") + 1).alias("part"), *[F.col(f"r.{c}").alias(c) for c in ARRAYS])


def element_nrows(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.size("seqnames").alias("n"))


def get(df: DataFrame, key: str, value: object) -> DataFrame:
    """The ranges of one group."""
    return unlist(df.where(F.col(key) == F.lit(value)), key).drop(key)


def list_range(df: DataFrame, key: str, ignore_strand: bool = False) -> DataFrame:
    """The span of each group, sequence and strand, as groups again; groups without ranges keep empty arrays."""
    flat = unlist(df, key)
    flat = flat.withColumn("strand", F.lit("*")) if ignore_strand else flat
    spans = flat.groupBy(key, "seqnames", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    rows = spans.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("seqnames", "strand", "start", "end"))).alias("r"))
    out = df.select(key).join(rows, key, "left")
    kinds = {"start": "array<int>", "end": "array<int>"}
    return out.select(key, *[F.coalesce(part("r", c), F.array().cast(kinds.get(c, "array<string>"))).alias(c) for c in ARRAYS])


def rename(df: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """Groups under new names; ``names`` holds (key, name)."""
    return df.join(names, key, "left").withColumn(key, F.coalesce("name", F.col(key))).drop("name")
