"""Running aggregates along sequences, split so that one long sequence is many tasks.

A window per sequence has as many tasks as there are sequences. Here positions fall into bins; a window
runs inside each bin, totals of bins (few rows) are chained per sequence, and what came before a bin is
joined to it on the window's own partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bases per bin of a scan.
WIDTH = 1 << 16
FUNCTIONS = {"sum": F.sum, "max": F.max, "min": F.min}


def joined(kind: str, near: Column, far: Column) -> Column:
    if kind == "sum":
        return F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0))
    return F.greatest(near, far) if kind == "max" else F.least(near, far)


def running(events: DataFrame, group: list[str], pos: str, columns: dict[str, tuple[str, str]], *, then: list[str] = (), reverse: bool = False, before: bool = False, following: str | None = None, bins: bool = False, width: int = WIDTH) -> DataFrame:
    """``events`` with running aggregates in the order of ``pos``, then ``then``.

    ``columns`` maps a new name to (sum, max or min; source column). ``before`` leaves the own row out;
    ``reverse`` runs from the end; ``following`` names a column for the next position of the sequence; ``bins`` keeps the column
    ``__bin``, by which (and ``group``) the rows stay dealt out and sorted.
    Nulls are skipped. Rows that tie in the whole order must be interchangeable.
    """
    bin_ = F.floor(F.col(pos) / F.lit(width))
    rows = events.withColumn("__bin", bin_)
    keys = [*group, "__bin"]
    order = [F.col(c).desc() if reverse else F.col(c).asc() for c in (pos, *then)]
    across = Window.partitionBy(*group).orderBy(F.col("__bin").desc() if reverse else F.col("__bin").asc())
    chain = across.rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys).agg(*[FUNCTIONS[f](c).alias(f"__t_{n}") for n, (f, c) in columns.items()], F.min(pos).alias("__first"))
    carry = totals.select(*keys, *[FUNCTIONS[f](f"__t_{n}").over(chain).alias(f"__c_{n}") for n, (f, _) in columns.items()], *([F.lead("__first").over(across).alias("__next")] if following else []))
    inside = Window.partitionBy(*keys).orderBy(*order)
    frame = inside.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    out = rows.join(carry, keys)
    out = out.select(
        *[F.col(c) for c in events.columns], *([F.col("__bin")] if bins else []),
        *[joined(f, FUNCTIONS[f](c).over(frame), F.col(f"__c_{n}")).alias(n) for n, (f, c) in columns.items()],
        *([F.coalesce(F.lead(pos).over(inside), F.col("__next")).alias(following)] if following else []),
    )
    return out


def runs(changes: DataFrame, group: list[str], names: list[str], keep: Callable[[list[Column]], Column], width: int = WIDTH) -> DataFrame:
    """(group, lo, hi): the longest stretches over which ``keep`` holds of the running sums of ``names``; ``changes`` has a row per position.

    An edge is a position where the condition changes: it is asked of the sums with and without the change. Edges of one bin are
    paired there, on the partitioning of the sums; what is open at the end of a bin and what is closed first in a later one are at most
    two edges a bin, and those are paired along the sequence.
    """
    summed = running(changes, group, "pos", {f"__s_{n}": ("sum", n) for n in names}, bins=True, width=width)
    now, was = keep([F.col(f"__s_{n}") for n in names]), keep([F.col(f"__s_{n}") - F.col(n) for n in names])
    edges = summed.where(now != was).select(*group, "__bin", "pos", now.alias("opens"))
    inside = Window.partitionBy(*group, "__bin").orderBy("pos")
    marked = edges.withColumns({"next": F.lead("pos").over(inside), "last": F.lag("pos").over(inside)})
    loose = F.when(F.col("opens"), F.col("next")).otherwise(F.col("last")).isNull()
    # One frame for both kinds: what is paired keeps to its bin, what is loose shares a key along the sequence.
    kept = marked.where(F.col("opens") | loose).select(*group, "pos", "opens", "next", F.when(~loose, F.col("__bin")).alias("__with"))
    after = F.lead("pos").over(Window.partitionBy(*group, "__with").orderBy("pos"))
    paired = kept.withColumn("next", F.coalesce("next", F.when(F.col("__with").isNull(), after))).where("opens")
    return paired.select(*group, F.col("pos").alias("lo"), (F.col("next") - 1).alias("hi"))


#: Powers of two up to a bin's width, falling.
STEPS = [1 << k for k in range(WIDTH.bit_length() - 1, -1, -1)]


def bin_of(pos: Column, width: int = WIDTH) -> Column:
    return F.floor(pos / F.lit(width))


def upto(places: Column, x: Column) -> Column:
    """How many of the ascending ``places``, no more than a bin has, are at most ``x``: a binary search, as many steps as the array needs."""
    n = F.size(places)
    need = F.greatest(F.ceil(F.log2(n + 1)), F.lit(1)).cast("int")
    steps = F.slice(F.array(*[F.lit(k) for k in STEPS]), F.lit(len(STEPS)) - need + 1, need)
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(places, at + step - 1) <= x), at + step).otherwise(at))
    return F.when(n > 0, found).otherwise(0)


def column_of(rows: str, name: str) -> Column:
    """One field of an array of structs, as an array."""
    return F.transform(rows, lambda x: x[name])


def asked_bins(asks: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct bins (``keys``, __bin) of some asks; few rows, whatever the asks."""
    return asks.select(*keys, "__bin").distinct()


def sums_by_bin(changes: DataFrame, asked: DataFrame, group: list[str], sums: list[str], width: int = WIDTH) -> DataFrame:
    """(group, __bin, places, before_<sum>, <sum>): one row for each bin that has changes or is asked: the positions of its changes, what the sums are before the
    bin, and at each position.

    ``changes`` has a row per position, so a row is bounded by the bin's width, and asks join to it as to any table: a position that a
    third of all asks share is a skewed join key, which AQE splits, and no window holds an ask.
    """
    keys = [*group, "__bin"]
    rows = changes.withColumn("__bin", bin_of(F.col("pos"), width))
    inside = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.select(*keys, "pos", *[F.sum(c).over(inside).alias(c) for c in sums])
    held = run.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", *sums))).alias("r"))
    held = held.select(*keys, *[column_of("r", c).alias(n) for c, n in [("pos", "places"), *((c, c) for c in sums)]])
    totals = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).unionByName(asked.select(*keys, *[F.lit(0).cast("long").alias(c) for c in sums]))
    earlier = Window.partitionBy(*group).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    chain = totals.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).select(*keys, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in sums])
    return chain.join(held, keys, "left")


def next_by_bin(known: DataFrame, asked: DataFrame, group: list[str], values: list[str], width: int = WIDTH) -> DataFrame:
    """(group, __bin, places, <values>, after): one row for each bin that has known positions or is asked: its positions with their values, and the first
    (pos, values) of a later bin.
    """
    keys = [*group, "__bin"]
    rows = known.withColumn("__bin", bin_of(F.col("pos"), width))
    held = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", *values))).alias("r"))
    every = held.unionByName(asked.select(*keys, F.lit(None).cast(held.schema["r"].dataType).alias("r"))).groupBy(*keys).agg(F.first("r", True).alias("r"))
    # From the last bin on: a frame that grows, not one that is read anew for each bin.
    later = Window.partitionBy(*group).orderBy(F.col("__bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = every.withColumn("after", F.last(F.get("r", F.lit(0)), True).over(later))
    return out.select(*keys, *[column_of("r", c).alias(n) for c, n in [("pos", "places"), *((c, c) for c in values)]], "after")


def edges_by_bin(changes: DataFrame, asked: DataFrame, group: list[str], width: int = WIDTH) -> DataFrame:
    """(group, __bin, starts, up, before_up, later, ends, down, before_down, earlier): one row for each bin that has changes or is asked: where ranges start and end
    in it, how many have at each of these positions and before the bin, the first start of a later bin and the last end of an earlier one.

    ``changes`` has a row per position, with the ranges that start (``up``) and end (``down``) there.
    """
    keys = [*group, "__bin"]
    none = {"pos": F.lit(None).cast("long"), "up": F.lit(0).cast("long"), "down": F.lit(0).cast("long")}
    rows = changes.withColumn("__bin", bin_of(F.col("pos"), width)).unionByName(asked.select(*keys, *[c.alias(n) for n, c in none.items()]))
    inside = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.select(*keys, *none, *[F.sum(c).over(inside).alias(f"n_{c}") for c in ("up", "down")])
    places = lambda c: F.sort_array(F.collect_list(F.when(F.col(c) > 0, F.struct("pos", F.col(f"n_{c}").alias("n")))))
    held = run.groupBy(*keys).agg(places("up").alias("s"), places("down").alias("e"))
    back = Window.partitionBy(*group).orderBy(F.col("__bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    last = {c: F.get(c, F.size(c) - 1) for c in "se"}
    before = lambda c: F.coalesce(F.sum(F.coalesce(last[c]["n"], F.lit(0))).over(earlier), F.lit(0))
    out = held.withColumns({"later": F.last(F.get("s", F.lit(0))["pos"], True).over(back), "earlier": F.last(last["e"]["pos"], True).over(earlier), "before_up": before("s"), "before_down": before("e")})
    arrays = [column_of(r, c).alias(n) for r, c, n in (("s", "pos", "starts"), ("s", "n", "up"), ("e", "pos", "ends"), ("e", "n", "down"))]
    return out.select(*keys, *arrays, "later", "earlier", "before_up", "before_down")
