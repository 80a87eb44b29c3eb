"""The least place among the ranges that overlap a query, without pairs.

A range overlaps a query if it starts inside it, or if it is open where the query begins. Coordinates are
cut into blocks of 1, 4, 16, ... bases. For the first question every start stands in its block of each level, and a query asks the few
blocks that make it up; for the second a range stands in the blocks that make it up, and a query asks the block of each level around its
begin. A block keeps one place, so the joins are look-ups in a table of distinct keys: however deep a pile, they give no more rows than the
queries ask, a logarithm of the widths each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.expr import compatible
from spanforge.plans.storage import written

BLOCK = ["seqnames", "side", "part", "level", "block"]


def made_up_of(lo: str, hi: str, top: int) -> str:
    """SQL for the largest blocks, up to a level, that make up the columns [lo, hi]: six a level at most; none if hi < lo."""
    first = lambda k: f"shiftright({lo} + shiftleft(1L, 2 * ({k})) - 1, 2 * ({k}))"
    beyond = lambda k: f"shiftright({hi} + 1, 2 * ({k}))"
    run = lambda a, b: f"IF({a} < {b}, sequence({a}, {b} - 1), CAST(array() AS array<bigint>))"
    up, down = f"4 * {first('k + 1')}", f"4 * {beyond('k + 1')}"
    # What whole blocks of the next level take is left out.
    here = f"IF(k < {top} AND {up} < {down}, concat({run(first('k'), up)}, {run(down, beyond('k'))}), {run(first('k'), beyond('k'))})"
    return f"flatten(transform(sequence(0, {top}), k -> transform({here}, b -> named_struct('level', k, 'block', b))))"


def around(at: str, top: int) -> str:
    """SQL for the block of every level that holds a position."""
    return f"transform(sequence(0, {top}), k -> named_struct('level', k, 'block', shiftright({at}, 2 * k)))"


def placed(rows: DataFrame, keep: list[str], parts: dict[str, str]) -> DataFrame:
    """``rows`` once for every block of every part."""
    every = "concat({})".format(", ".join(f"transform({blocks}, x -> named_struct('part', '{part}', 'level', x.level, 'block', x.block))" for part, blocks in parts.items()))
    return rows.select(*keep, F.explode(F.expr(every)).alias("x")).select(*keep, "x.*")


def level_of(width: int) -> int:
    """The highest level of which a range of this width can hold a block."""
    return max(int(width).bit_length() - 1, 0) // 2


def least_hits(query: DataFrame, subject: DataFrame, *, last: bool = False, maxgap: int = -1, minoverlap: int = 0, ignore_strand: bool = False, own: bool = False) -> DataFrame:
    """(query_idx, subject_idx) of the queries that overlap something: the least place, with ``last`` the greatest; with ``own`` another one than the query's.

    With ``minoverlap`` of m > 1 ranges of fewer bases are left out, and of the others an overlap of m is one of ranges that end m - 1 bases sooner.
    Empty ranges overlap what has bases on both sides of them. What has no sequence, strand or coordinate overlaps nothing.
    """
    m = max(minoverlap, 1)
    g = maxgap + 1 if m == 1 else 0
    start, end = F.col("start").cast("long"), F.col("end").cast("long")
    side = lambda strands: F.lit("*") if ignore_strand else strands
    wide = lambda df: df.where(end - start + 1 >= m) if m > 1 else df
    q = wide(query).select("rid", "seqnames", side(F.col("strand")).alias("side"), (start - g).alias("a"), (end + g - m + 1).alias("b"))
    s = wide(subject).select("rid", "seqnames", side(F.explode(compatible(F.col("strand")))).alias("side"), start.alias("s"), (end - m + 1).alias("e"))
    most = q.select((F.col("b") - F.col("a") + 1).alias("q"), F.lit(0).alias("s")).unionByName(s.select(F.lit(0).alias("q"), (F.col("e") - F.col("s") + 1).alias("s"))).agg(F.max("q"), F.max("s")).first()
    # Starts are counted double, those of empty ranges lie half a base before, so that a query never takes one at its own edge.
    asks, open_ = level_of(2 * (most[0] or 0) + 1), level_of(most[1] or 0)
    q = q.withColumns({"lo": 2 * F.col("a") + 1, "hi": 2 * F.col("b") + 1})
    s = s.withColumns({"at": 2 * F.col("s") + (F.col("e") >= F.col("s")).cast("long"), "next": F.col("s") + 1})
    blocks = placed(s, ["rid", "seqnames", "side"], {"start": around("at", asks), "open": made_up_of("next", "e", open_)})
    if own:
        # The two least of a block: one of them is not the query itself.
        rank = F.row_number().over(Window.partitionBy(*BLOCK).orderBy(F.col("rid").desc() if last else F.col("rid")))
        blocks = blocks.withColumn("n", rank).where("n <= 2")
    pick, second = (F.max, F.min) if last else (F.min, F.max)
    table = written(blocks.groupBy(*BLOCK).agg(pick("rid").alias("one"), *([second("rid").alias("other")] if own else [])))
    found = placed(q, ["rid", "seqnames", "side"], {"start": made_up_of("lo", "hi", asks), "open": around("a", open_)}).join(table, BLOCK)
    one: Column = F.col("one")
    if own:
        one = F.when(one != F.col("rid"), one).when(F.col("other") != F.col("rid"), F.col("other"))
    best = found.groupBy(F.col("rid").alias("query_idx")).agg(pick(one).alias("subject_idx"))
    return best.where("subject_idx is not null")
