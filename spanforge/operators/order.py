"""Order, rank, duplicates, heads and tails.

Sequences sort as text, strands as ``*``, ``+``, ``-``; the place breaks ties.
"""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from spanforge.plans.ordinals import placed, with_ordinal

LEVEL = "__level"


def keys(ignore_strand: bool, level_order: list[str] | None = None) -> list[str]:
    return [*([LEVEL] if level_order else []), "seqnames", *([] if ignore_strand else ["strand"]), "start", "end"]


def sort_order(decreasing: bool, ignore_strand: bool, level_order: list[str] | None = None) -> list[Column]:
    return [F.col(c).desc() if decreasing else F.col(c).asc() for c in keys(ignore_strand, level_order)] + [F.col("rid").asc()]


def leveled(df: DataFrame, level_order: list[str] | None) -> DataFrame:
    """``df`` with the place of its sequence in ``level_order``, where one is given; sequences that it does not name come after all others, as text."""
    if not level_order:
        return df
    levels = df.sparkSession.createDataFrame([(n, k) for k, n in enumerate(dict.fromkeys(level_order))], f"seqnames string, {LEVEL} int")
    # As small as the list that was given: Spark knows its size, and broadcasts it while that is small.
    return df.join(levels, "seqnames", "left").withColumn(LEVEL, F.coalesce(LEVEL, F.lit(len(level_order))))


def sort(df: DataFrame, decreasing: bool = False, ignore_strand: bool = False, level_order: list[str] | None = None) -> DataFrame:
    return leveled(df, level_order).orderBy(*sort_order(decreasing, ignore_strand, level_order)).select(*df.columns)


def order(df: DataFrame, decreasing: bool = False, ignore_strand: bool = False, level_order: list[str] | None = None) -> DataFrame:
    """(pos, rid): the place of the range that sorts at each position; ``level_order`` puts sequences in an order of their own, chr2 before chr10. Nulls come first."""
    return with_ordinal(leveled(df.select("rid", *keys(False)), level_order), sort_order(decreasing, ignore_strand, level_order), "pos").select("pos", "rid")


def rank(df: DataFrame, ties: str = "first", ignore_strand: bool = False, level_order: list[str] | None = None) -> DataFrame:
    """(rid, rank) of every range, nulls first. first: ties by place; min: all get the least (gaps follow); dense: no gaps."""
    by = keys(ignore_strand, level_order)
    rows = leveled(df.select("rid", *keys(False)), level_order).select("rid", *by)
    if ties == "dense":
        ranks = with_ordinal(rows.select(*by).distinct(), [F.col(c) for c in by], "rank")
    else:
        first = with_ordinal(rows, sort_order(False, ignore_strand, level_order), "rank")
        if ties == "first":
            return first.select("rid", "rank")
        if ties != "min":
            raise ValueError("ties is first, min or dense")
        rows, ranks = first.select("rid", *by), first.groupBy(*by).agg(F.min("rank").alias("rank"))
    # Null keys are equal to one another here as in any order.
    a, b = rows.alias("a"), ranks.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    return a.join(b, fold(Column.__and__, same)).select("a.rid", "b.rank")


def is_unsorted(df: DataFrame, strictly: bool = False, ignore_strand: bool = False, level_order: list[str] | None = None) -> DataFrame:
    """One row, is_unsorted: some range sorts after the next (or, strictly, no earlier). Places must be 1..n."""
    df = leveled(df, level_order)
    key = F.struct(*keys(ignore_strand, level_order))
    a = df.select("rid", key.alias("k"))
    b = df.select((F.col("rid") - 1).alias("rid"), key.alias("next"))
    bad = F.col("k") >= F.col("next") if strictly else F.col("k") > F.col("next")
    return a.join(b, "rid").agg(F.coalesce(F.max(bad), F.lit(False)).alias("is_unsorted"))


def kept_places(df: DataFrame, from_last: bool) -> DataFrame:
    return df.groupBy(*keys(False)).agg((F.max if from_last else F.min)("rid").alias("rid")).select("rid")


def duplicated(df: DataFrame, from_last: bool = False) -> DataFrame:
    """(rid, duplicated). The join is on places, so a range with many copies is no heavy key."""
    kept = kept_places(df, from_last).withColumn("kept", F.lit(True))
    return df.select("rid").join(kept, "rid", "left").select("rid", F.col("kept").isNull().alias("duplicated"))


def unique(df: DataFrame, from_last: bool = False) -> DataFrame:
    """The first (or last) of each distinct range; metadata stay."""
    return df.join(kept_places(df, from_last), "rid", "left_semi")


def head(df: DataFrame, n: int = 6, place: str = "rid") -> DataFrame:
    """The first ``n`` places; all but the last -n if negative, a condition on places."""
    if n >= 0:
        return df.orderBy(place).limit(n)
    rows, total = placed(df, [F.col(place)], "__pos")
    return rows.where(F.col("__pos") <= total + n).drop("__pos")


def tail(df: DataFrame, n: int = 6, place: str = "rid") -> DataFrame:
    """The last ``n`` places; all but the first -n if negative, a condition on places."""
    if n >= 0:
        return df.orderBy(F.col(place).desc()).limit(n).orderBy(place)
    return with_ordinal(df, [F.col(place)], "__pos").where(F.col("__pos") > -n).drop("__pos")


def take(df: DataFrame, positions: list[int]) -> DataFrame:
    """Rows at 1-based positions among those that are there now, whatever places they have; each once, and with the place it had."""
    rows = with_ordinal(df, [F.col("rid")], "__pos")
    return rows.join(numbered(rows, list(dict.fromkeys(positions)), "__pos"), "__pos", "left_semi").select(*df.columns)


def numbered(df: DataFrame, values: list, name: str) -> DataFrame:
    """(name, __new): the given values with their places; a table, so that a long list is a join and no literal."""
    kind = df.schema[name].dataType
    return df.sparkSession.createDataFrame([(v, k + 1) for k, v in enumerate(values)], StructType([StructField(name, kind), StructField("__new", LongType())]))


def pick(df: DataFrame, positions: list[int], place: str = "rid") -> DataFrame:
    """Rows at 1-based positions among those that are there now, in the order given and as often as given; ``place`` is their new place.

    Negative positions leave those rows out; positions beyond the rows raise nothing and give nothing.
    """
    rows = with_ordinal(df, [F.col(place)], "__pos")
    if positions and all(p < 0 for p in positions):
        left = rows.join(numbered(rows, [-p for p in positions], "__pos"), "__pos", "left_anti")
        return with_ordinal(left.drop(place), [F.col("__pos")], place).select(*df.columns)
    if any(p <= 0 for p in positions):
        raise ValueError("positions are from 1 on, or all negative")
    return rows.drop(place).join(numbered(rows, positions, "__pos"), "__pos").withColumn(place, F.col("__new")).select(*df.columns)


def pick_names(df: DataFrame, key: str, names: list, place: str = "rid") -> DataFrame:
    """Rows whose ``key`` is one of ``names``, in the order given and as often as given; names without rows give nothing."""
    return df.drop(place).join(numbered(df, names, key), key).withColumn(place, F.col("__new")).select(*df.columns)


def between(df: DataFrame, start: int | None, stop: int | None, step: int | None = None, place: str = "rid") -> DataFrame:
    """Rows from 0-based position ``start`` to before ``stop``, every ``step``-th: a condition on places, whatever their number."""
    first, step = start or 0, step or 1
    if first < 0 or (stop or 0) < 0 or step < 1:
        raise ValueError("slices count from the first row on and forwards")
    rows = with_ordinal(df, [F.col(place)], "__pos")
    at = F.col("__pos") - 1 - first
    kept = rows.where((at >= 0) & (at % step == 0) & (F.lit(True) if stop is None else F.col("__pos") <= stop))
    return kept.withColumn(place, F.floor(at / step) + 1).select(*df.columns)
