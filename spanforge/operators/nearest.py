"""Neighbours: precede, follow, nearest, distance to nearest.

The next subject beyond a query is looked up: subjects are summed up by coordinate, so ties are least and greatest places, and the
coordinates of a bin are one row, with the first of a later bin; looking to the left is looking to the right on mirrored coordinates. Queries join to the rows of their
bins, so many queries at one place are a skewed join and nothing more. Strands are an
equality key: a subject stands under every query strand that can see it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.expr import compatible, strand_ok
from spanforge.operators.overlaps import flat_plan, one_hit, overlap_pairs
from spanforge.plans.scan import WIDTH, asked_bins, bin_of, edges_by_bin, next_by_bin, upto
from spanforge.plans.storage import written

SPACE = ["seqnames", "side", "right"]

#: Query strands under which a subject strand is read forwards, and backwards.
FORWARD = {"+": ("+", "*"), "*": ("+", "*")}
BACKWARD = {"-": ("-", "*"), "*": ("-",)}


def mirrored(right: Column, at: Column, other: Column) -> Column:
    """``at`` where one looks to the right, ``other`` with its sign turned where one looks to the left."""
    return F.when(right, at).otherwise(-other).cast("long")


def seen_from(strand: Column, lists: list[tuple[bool, dict[str, tuple[str, ...]]]]) -> Column:
    """(side, right) rows: the query strands that see a subject of ``strand``, and in which direction."""
    kind = "array<struct<side:string,right:boolean>>"
    out = F.array().cast(kind)
    for k in {k for _, table in lists for k in table}:
        views = [F.struct(F.lit(side).alias("side"), F.lit(right).alias("right")) for right, table in lists for side in table.get(k, ())]
        out = F.when(strand == k, F.array(*views).cast(kind)).otherwise(out)
    return F.explode(out)


def subjects(subject: DataFrame, views: Column) -> DataFrame:
    """(seqnames, side, right, coord, rid): each subject under every strand and direction from which it is seen."""
    rows = subject.select("rid", "seqnames", "start", "end", views.alias("v")).select("rid", "seqnames", "start", "end", "v.*")
    return rows.select(*SPACE, mirrored(F.col("right"), F.col("start"), F.col("end")).alias("coord"), "rid")


def beside(x: DataFrame, seen: DataFrame, directions: tuple[bool, ...], side: Column, margin: int, width: int) -> DataFrame:
    """(rid, seqnames, side, right, coord, low, high, dist) of every x and direction: the closest coordinate more than ``margin`` beyond it, null if none.

    ``low`` and ``high`` are the least and greatest place there, ``dist`` counts from the margin on. The inequality is strict; empty ranges count from their start. An x
    without a sequence, strand or coordinate has no neighbour, and its rows.
    """
    known = seen.groupBy(*SPACE, F.col("coord").alias("pos")).agg(F.min("rid").alias("low"), F.max("rid").alias("high"))
    start, end = F.col("start").cast("long"), F.col("end").cast("long")
    to = F.explode(F.array(*[F.lit(d) for d in directions]))
    asks = x.select("rid", "seqnames", side.alias("side"), (start - margin).alias("lo"), (F.greatest(end, start - 1) + margin if margin else end).alias("hi"), to.alias("right"))
    asks = asks.select("rid", *SPACE, mirrored(F.col("right"), F.col("hi"), F.col("lo")).alias("ask")).withColumn("__bin", bin_of(F.col("ask"), width))
    bins = written(next_by_bin(known, asked_bins(asks, keys=SPACE), SPACE, ["low", "high"], width))
    found = asks.join(bins, [*SPACE, "__bin"], "left").withColumn("k", upto(F.col("places"), F.col("ask")))
    inside = F.coalesce(F.col("k") < F.size("places"), F.lit(False))
    pick = lambda array, of: F.when(inside, F.get(array, F.col("k"))).otherwise(F.col(f"after.{of}"))
    return found.select("rid", *SPACE, pick("places", "pos").alias("coord"), pick("low", "low").alias("low"), pick("high", "high").alias("high"), (pick("places", "pos") - F.col("ask")).alias("dist"))


def directed(x: DataFrame, subject: DataFrame, forward_right: bool, select: str, one: str, ignore_strand: bool, width: int) -> DataFrame:
    if ignore_strand:
        directions, side, views = (forward_right,), F.lit("*"), F.explode(F.array(F.struct(F.lit("*").alias("side"), F.lit(forward_right).alias("right"))))
    else:
        directions, side, views = (True, False), F.col("strand"), seen_from(F.col("strand"), [(forward_right, FORWARD), (not forward_right, BACKWARD)])
    seen = subjects(subject, views)
    found = beside(x, seen, directions, side, 0, width)
    if select != "all":
        # Of equal distances the least or the greatest place; every x has a row, so none is joined back.
        place = F.col("low") if one == "first" else -F.col("high")
        best = found.groupBy("rid").agg(F.min(F.when(F.col("coord").isNotNull(), F.struct("dist", place.alias("place")))).alias("b"))
        return best.select(F.col("rid").alias("query_idx"), (F.col("b.place") if one == "first" else -F.col("b.place")).alias("subject_idx"))
    return ties(found, seen).select("query_idx", "subject_idx")


def ties(found: DataFrame, seen: DataFrame) -> DataFrame:
    """Every subject at the closest coordinates of each x."""
    found = found.where("coord is not null")
    best = found.groupBy("rid").agg(F.min("dist").alias("best"))
    won = found.join(best, "rid").where("dist = best").select(F.col("rid").alias("query_idx"), *SPACE, "coord", "dist")
    return won.join(seen.withColumnRenamed("rid", "subject_idx"), [*SPACE, "coord"]).select("query_idx", "subject_idx", "dist")


def precede(x: DataFrame, subject: DataFrame | None = None, select: str = "first", ignore_strand: bool = False, width: int = WIDTH) -> DataFrame:
    """The first subject behind each x in the direction of transcription; null if none. ``all``: every tie, a row each."""
    return directed(x, x if subject is None else subject, True, select, "first", ignore_strand, width)


def follow(x: DataFrame, subject: DataFrame | None = None, select: str = "last", ignore_strand: bool = False, width: int = WIDTH) -> DataFrame:
    """The last subject in front of each x in the direction of transcription; ties give the greatest place."""
    return directed(x, x if subject is None else subject, False, select, "last", ignore_strand, width)


def nearest_all(x: DataFrame, subject: DataFrame, own: bool, ignore_strand: bool, width: int) -> DataFrame:
    """(query_idx, subject_idx, distance): every subject that touches each x, or else every one at the least distance; with ``own`` other ones than x.

    One look-up counts what touches an x (starts up to behind it, less ends before it) and finds the closest coordinates on both sides. Then only an x that touches
    something is paired, and only the others ask for their coordinates.
    """
    known, keys = "start is not null and end is not null", ["seqnames", "side"]
    x, s = x.where(known), subject.where(known)
    start, end = F.col("start").cast("long"), F.col("end").cast("long")
    edges = F.explode(F.array(F.struct(start.alias("pos"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(end.alias("pos"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    seen = s.select("seqnames", (F.lit("*") if ignore_strand else F.explode(compatible(F.col("strand")))).alias("side"), "start", "end").select(*keys, edges.alias("e"))
    changes = seen.groupBy(*keys, F.col("e.pos").alias("pos")).agg(*[F.sum(f"e.{c}").alias(c) for c in ("up", "down")])
    at = {"lo": start - 1, "hi": F.greatest(end, start - 1) + 1}
    asks = x.select(F.col("rid").alias("query_idx"), "seqnames", (F.lit("*") if ignore_strand else F.col("strand")).alias("side"), "start", "end")
    asks = asks.withColumns({f"__{edge}": bin_of(place, width) for edge, place in at.items()})
    bins = written(edges_by_bin(changes, asked_bins(asks.withColumn("__bin", F.explode(F.array("__lo", "__hi"))), keys), keys, width))
    held = {"lo": ("ends", "down", "before_down", "earlier"), "hi": ("starts", "up", "before_up", "later")}

    def looked_up(rows: DataFrame, *edges: str) -> DataFrame:
        """``rows`` with what ended before ``lo`` and the last end there, with what has started up to ``hi`` and the first start beyond; these share a bin."""
        near = f"__{edges[0]}"
        out = rows.join(bins.select(*keys, F.col("__bin").alias(near), *[c for edge in edges for c in held[edge]]), [*keys, near], "left").drop(near)
        for edge in edges:
            (places, counts, before, far), less = held[edge], int(edge == "lo")
            out = out.withColumn("k", upto(F.col(places), at[edge] - less))
            n = F.coalesce(F.col(before) + F.when(F.col("k") > 0, F.get(counts, F.col("k") - 1)).otherwise(0), F.lit(0))
            out = out.withColumns({f"n_{edge}": n, f"to_{edge}": F.coalesce(F.get(places, F.col("k") - less), far)}).drop("k", *held[edge])
        return out

    # Most ranges lie in one bin, and are moved once.
    one = looked_up(asks.where("__lo = __hi").drop("__hi"), "lo", "hi")
    two = looked_up(looked_up(asks.where("__lo <> __hi"), "lo"), "hi")
    touched = F.col("n_hi") - F.col("n_lo") > int(own)
    left, right = at["lo"] - F.col("to_lo"), F.col("to_hi") - at["hi"]
    least = F.least(left, right)
    first = written(one.unionByName(two).select(
        "query_idx", "seqnames", F.col("side").alias("strand"), *[F.when(touched, F.col(c)).alias(c) for c in ("start", "end")],
        *[F.when(~touched & (d == least), F.col(c)).alias(c) for c, d in (("to_lo", left), ("to_hi", right))], F.when(~touched, least).alias("distance"),
    ))
    touching = first.where("start is not null").select(F.col("query_idx").alias("rid"), "seqnames", "start", "end", "strand")
    zero = overlap_pairs(touching, s, maxgap=0, ignore_strand=ignore_strand, bins=flat_plan(touching, s, 0))
    # Written, so that what the pairs moved is gone before the others move.
    zero = written(zero.where("query_idx <> subject_idx") if own else zero)
    place = lambda lo, hi: F.explode(F.array(F.struct(F.lit(False).alias("right"), F.col(lo).cast("long").alias("coord")), F.struct(F.lit(True).alias("right"), F.col(hi).cast("long").alias("coord"))))
    asked = first.where("to_lo is not null or to_hi is not null").select("query_idx", "seqnames", "strand", "distance", place("to_lo", "to_hi").alias("p")).where("p.coord is not null")
    there = s.select(F.col("rid").alias("subject_idx"), "seqnames", F.col("strand").alias("other"), place("end", "start").alias("p"))
    met = asked.select("query_idx", "strand", "distance", "seqnames", "p.*").join(there.select("subject_idx", "other", "seqnames", "p.*"), ["seqnames", "right", "coord"])
    met = met if ignore_strand else met.where(strand_ok(F.col("strand"), F.col("other")))
    return zero.select("query_idx", "subject_idx", F.lit(0).cast("long").alias("distance")).unionByName(met.select("query_idx", "subject_idx", "distance"))


def nearest_hits(x: DataFrame, subject: DataFrame | None, select: str, ignore_strand: bool, width: int) -> DataFrame:
    """(query_idx, subject_idx, distance); with one hit a row for every x, null without a neighbour."""
    self_ = subject is None
    subject = x if self_ else subject
    if select == "all":
        return nearest_all(x, subject, self_, ignore_strand, width)
    touching = one_hit(x, subject, own=self_, maxgap=0, ignore_strand=ignore_strand)
    strands = F.array(F.lit("*")) if ignore_strand else compatible(F.col("strand"))
    both = F.array(F.lit(True), F.lit(False))
    views = F.explode(F.flatten(F.transform(strands, lambda s: F.transform(both, lambda r: F.struct(s.alias("side"), r.alias("right"))))))
    # Beyond the touching ones: two bases away at least, which also keeps x from finding itself.
    beyond = beside(x, subjects(subject, views), (True, False), F.lit("*") if ignore_strand else F.col("strand"), 1, width)
    zero = touching.groupBy(F.col("query_idx").alias("rid")).agg(F.min("subject_idx").alias("low")).select("rid", F.lit(0).cast("long").alias("dist"), "low")
    every = zero.unionByName(beyond.select("rid", "dist", "low"))
    best = every.groupBy("rid").agg(F.min(F.when(F.col("low").isNotNull(), F.struct("dist", "low"))).alias("b"))
    return best.select(F.col("rid").alias("query_idx"), F.col("b.low").alias("subject_idx"), F.col("b.dist").alias("distance"))


def nearest(x: DataFrame, subject: DataFrame | None = None, select: str = "arbitrary", ignore_strand: bool = False, width: int = WIDTH) -> DataFrame:
    """The closest subject of each x, null if none; without a subject its own neighbours, never itself. Touching counts as distance 0."""
    return nearest_hits(x, subject, select, ignore_strand, width).select("query_idx", "subject_idx")


def distance_to_nearest(x: DataFrame, subject: DataFrame | None = None, select: str = "arbitrary", ignore_strand: bool = False, width: int = WIDTH) -> DataFrame:
    """(query_idx, subject_idx, distance) of each x that has a neighbour."""
    return nearest_hits(x, subject, select, ignore_strand, width).where("subject_idx is not null")
