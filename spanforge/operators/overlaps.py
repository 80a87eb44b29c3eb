"""Overlap joins, counts and filters.

The join works on bins: every range goes to the bins it touches, at a level where it touches few, so
that (sequence, level, bin) is an equality key; a pair is kept only in the first bin that both touch.
Levels grow by a factor of 8, so one wide range does not become many rows. Kinds start, end and equal have the coordinate itself in the key. Counting needs no pairs:
overlaps = starts up to the query's end - ends before its start, both running sums of the subjects, which queries look up in the bins of their ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.expr import compatible, related, strand_ok
from spanforge.operators.stab import around, least_hits, level_of, made_up_of
from spanforge.plans.scan import WIDTH, asked_bins, bin_of, sums_by_bin, upto
from spanforge.plans.storage import written

#: Most bins of its own level that a range touches, about; factor between levels; levels in all.
FEW, FACTOR, LEVELS = 4, 8, 9
#: Edges (s, e) that a kind of overlap compares.
EDGES = {"start": "s", "end": "e", "equal": "se"}


def bin_plan(query: DataFrame, subject: DataFrame) -> tuple[int, int]:
    """Bin width (a power of two near the 90th percentile of widths, 64 at least), and the highest level that a range needs."""
    width = (F.col("end").cast("long") - F.col("start") + 1).alias("w")
    widths = query.select(width).unionByName(subject.select(width))
    p, most = widths.agg(F.percentile_approx("w", 0.9, 1000), F.max("w")).first()
    size = 1 << max(6, (max(int(p or 1), 1) - 1).bit_length())
    top = 0
    while most and most > FEW * size * FACTOR**top and top < LEVELS:
        top += 1
    return size, top


def binned(df: DataFrame, lo: Column, hi: Column, size: int, top: int) -> DataFrame:
    """Rows with level, own (the range's own level), bin and first bin: bins of the own level and of all above."""
    level = F.lit(0)
    for k in range(1, top + 1):
        level = F.when(hi - lo >= FEW * size * FACTOR ** (k - 1), F.lit(k)).otherwise(level)
    rows = df.withColumn("__own", level)
    rows = rows.withColumn("__level", F.explode(F.sequence(F.col("__own"), F.lit(top)))) if top else rows.withColumn("__level", F.lit(0))
    wide = F.lit(float(size)) * F.pow(F.lit(float(FACTOR)), F.col("__level"))
    rows = rows.withColumn("__first", F.floor(lo / wide)).withColumn("__last", F.floor(hi / wide))
    return rows.withColumn("__bin", F.explode(F.sequence("__first", "__last"))).drop("__last")


#: Columns by which a stored table is dealt out, and on which overlap joins meet.
PLACED = ["seqnames", "__level", "__bin"]


def store(df: DataFrame, table: str, path: str | None = None, buckets: int = 200) -> None:
    """``df`` as a table of the catalog laid out for overlap joins: a row for each bin that a range touches, in buckets by sequence, level and bin, sorted, in
    a folder per sequence.

    Joins with :func:`stored_pairs` find the stored side dealt out and sorted already; a condition on ``sequence`` prunes folders.
    """
    size, top = bin_plan(df, df.limit(0))
    start, end = F.col("start").cast("long"), F.col("end").cast("long")
    rows = binned(df.withColumn("sequence", F.col("seqnames")), F.least(start, end), F.greatest(start, end), size, LEVELS)
    # Once for every bin of the own level; the join asks on all levels.
    rows = rows.where(F.col("__level") == F.col("__own")).withColumn("__size", F.lit(size))
    out = rows.repartition(buckets, *PLACED).write.partitionBy("sequence").bucketBy(buckets, *PLACED).sortBy(*PLACED)
    (out if path is None else out.option("path", path)).saveAsTable(table)


def stored(spark: SparkSession, table: str) -> DataFrame:
    """The ranges of a stored table, each once; a condition on ``seqnames`` is one on folders too if it is also given for ``sequence``."""
    df = spark.table(table)
    return df.where("__bin = __first").drop("__own", "__level", "__first", "__bin", "__size")


def stored_pairs(query: DataFrame, table: str, *, sequences: list[str] | None = None, maxgap: int = -1, minoverlap: int = 0, kind: str = "any", ignore_strand: bool = False) -> DataFrame:
    """(query_idx, subject_idx) of overlaps with a stored table, of some sequences or all; only the query is dealt out. Its rows ask on every level that the table may have."""
    spark = query.sparkSession
    s = spark.table(table) if sequences is None else spark.table(table).where(F.col("sequence").isin(sequences))
    found = spark.table(table).select("__size").limit(1).collect()
    size = found[0][0] if found else 64
    levels = [r[0] for r in spark.table(table).select("__own").distinct().collect()] or [0]
    g = max(maxgap, -1) + 1
    start, end = F.col("start").cast("long"), F.col("end").cast("long")
    q = query.select(F.col("rid").alias("query_idx"), "seqnames", start.alias("qs"), end.alias("qe"), F.col("strand").alias("qx"))
    q = q if sequences is None else q.where(F.col("seqnames").isin(sequences))
    lo, hi = F.least("qs", "qe") - g, F.greatest("qs", "qe") + g
    # On each level of the table, the bins that the query touches there; a wide query touches many bins of narrow ranges, as it may meet one in each.
    at = q.withColumn("__level", F.explode(F.array(*[F.lit(k) for k in sorted(levels)])))
    wide = F.lit(float(size)) * F.pow(F.lit(float(FACTOR)), F.col("__level"))
    at = at.withColumn("q_first", F.floor(lo / wide)).withColumn("__bin", F.explode(F.sequence("q_first", F.floor(hi / wide))))
    j = at.join(s, PLACED)
    hit = related(kind, F.col("qs"), F.col("qe"), F.col("start").cast("long"), F.col("end").cast("long"), maxgap, minoverlap)
    if not ignore_strand:
        hit = hit & strand_ok(F.col("qx"), F.col("strand"))
    return j.where((F.col("__bin") == F.greatest("q_first", "__first")) & hit).select("query_idx", F.col("rid").alias("subject_idx"))


def overlap_pairs(query: DataFrame, subject: DataFrame, *, maxgap: int = -1, minoverlap: int = 0, kind: str = "any", ignore_strand: bool = False, bins: tuple[int, int] | None = None) -> DataFrame:
    """(query_idx, subject_idx) of every pair that overlaps, once. Kinds start, end and equal meet on their coordinates, all others in bins."""
    start, end = F.col("start").cast("long"), F.col("end").cast("long")
    q = query.select(F.col("rid").alias("query_idx"), "seqnames", start.alias("qs"), end.alias("qe"), F.col("strand").alias("qx"))
    s = subject.select(F.col("rid").alias("subject_idx"), "seqnames", start.alias("ss"), end.alias("se"), F.col("strand").alias("sx"))
    if kind in EDGES:
        off, keys = max(maxgap, 0), ["seqnames"]
        for edge in EDGES[kind]:
            # Bands as wide as the tolerance: what is that near lies in a query's own band or in a neighbour.
            at = F.floor(F.col(f"q{edge}") / (off + 1))
            q = q.withColumn(f"__{edge}", F.explode(F.sequence(at - 1, at + 1)) if off else F.col("qs" if edge == "s" else "qe"))
            s = s.withColumn(f"__{edge}", F.floor(F.col(f"s{edge}") / (off + 1)))
            keys.append(f"__{edge}")
        hit = related(kind, F.col("qs"), F.col("qe"), F.col("ss"), F.col("se"), maxgap, minoverlap)
        return q.join(s, keys).where(hit if ignore_strand else hit & strand_ok(F.col("qx"), F.col("sx"))).select("query_idx", "subject_idx")
    size, top = bins or bin_plan(query, subject)
    g = max(maxgap, -1) + 1
    q = binned(q, F.least("qs", "qe") - g, F.greatest("qs", "qe") + g, size, top).withColumnsRenamed({"__own": "q_own", "__first": "q_first"})
    s = binned(s, F.least("ss", "se"), F.greatest("ss", "se"), size, top).withColumnsRenamed({"__own": "s_own", "__first": "s_first"})
    j = q.join(s, ["seqnames", "__level", "__bin"])
    once = (F.col("__level") == F.greatest("q_own", "s_own")) & (F.col("__bin") == F.greatest("q_first", "s_first"))
    hit = related(kind, F.col("qs"), F.col("qe"), F.col("ss"), F.col("se"), maxgap, minoverlap)
    if not ignore_strand:
        hit = hit & strand_ok(F.col("qx"), F.col("sx"))
    return j.where(once & hit).select("query_idx", "subject_idx")


def at_edge(df: DataFrame, edge: str) -> DataFrame:
    """Each range as the one position that its start or end is."""
    return df.select("rid", "seqnames", F.col(edge).alias("start"), F.col(edge).alias("end"), "strand")


#: Pairs a range (candidates of the join on bins) from which on looking up blocks is less work than pairing.
PILED = 16


def piled(query: DataFrame, subject: DataFrame, bins: tuple[int, int], maxgap: int) -> bool:
    """Whether the join on bins would look at more than ``PILED`` pairs for each of its rows; counted by bin, without joining."""
    g = max(maxgap, -1) + 1
    start, end = F.col("start").cast("long"), F.col("end").cast("long")
    sides = [binned(df.select("seqnames", (F.least(start, end) - k).alias("lo"), (F.greatest(start, end) + k).alias("hi")), F.col("lo"), F.col("hi"), *bins).groupBy("seqnames", "__level", "__bin").agg(F.count("*").alias("n")) for df, k in ((query, g), (subject, 0))]
    rows = sides[0].withColumn("of", F.lit(0)).unionByName(sides[1].withColumn("of", F.lit(1)))
    per = rows.groupBy("seqnames", "__level", "__bin").agg(*[F.coalesce(F.sum(F.when(F.col("of") == k, F.col("n"))), F.lit(0)).cast("double").alias(f"n{k}") for k in (0, 1)])
    pairs, n = per.agg(F.sum(F.col("n0") * F.col("n1")), F.sum(F.col("n0") + F.col("n1"))).first()
    return (pairs or 0) > PILED * (n or 0)


def flat_plan(query: DataFrame, subject: DataFrame, maxgap: int = -1) -> tuple[int, int]:
    """``bin_plan`` without its lowest levels, as long as few pairs meet on the others: where ranges lie apart, each is moved once or twice instead of once a level."""
    size, top = bin_plan(query, subject)
    while top and not piled(query, subject, (size * FACTOR, top - 1), maxgap):
        size, top = size * FACTOR, top - 1
    return size, top


def one_hit(query: DataFrame, subject: DataFrame, last: bool = False, bins: tuple[int, int] | None = None, own: bool = False, blocks: bool | None = None, **options) -> DataFrame:
    """(query_idx, subject_idx) of the queries that overlap something: the least (or greatest) place among what they overlap, with ``own`` other than the query's.

    Only distinct ranges count: of equal subjects the one that can win, of equal queries one, whose answer is joined back on its coordinates. Where
    ranges lie in piles (``piled``; or as ``blocks`` says) they are looked up by blocks, else paired; both give the same. Kinds other than ``any`` are paired.
    """
    keys, pick = ["seqnames", "start", "end", "strand"], F.max if last else F.min
    if options.get("kind") in ("start", "end") and options.get("minoverlap", 0) < 1:
        # The other edge does not matter, so ranges that differ only there are one.
        query, subject = (at_edge(df, options["kind"]) for df in (query, subject))
    if options.get("kind", "any") != "any" or options.get("maxgap", -1) < -1:
        blocks = False
    elif blocks is None:
        bins = bins or bin_plan(query, subject)
        blocks = piled(query, subject, bins, options.get("maxgap", -1))
    plain = {k: v for k, v in options.items() if k != "kind"}
    if own:
        if blocks:
            return least_hits(query, subject, last=last, own=True, **plain)
        pairs = overlap_pairs(query, subject, bins=bins, **options).where("query_idx <> subject_idx")
        return pairs.groupBy("query_idx").agg(pick("subject_idx").alias("subject_idx"))
    q = query.select(*keys).distinct().withColumn("rid", F.struct(*keys))
    s = subject.groupBy(*keys).agg(pick("rid").alias("rid"))
    if blocks:
        best = least_hits(q, s, last=last, **plain)
    else:
        pairs = overlap_pairs(q, s, bins=bins or (None if options.get("kind") in EDGES else bin_plan(query, subject)), **options)
        best = pairs.groupBy("query_idx").agg(pick("subject_idx").alias("subject_idx"))
    return query.select(F.col("rid").alias("query_idx"), *keys).join(best.select("query_idx.*", "subject_idx"), keys).select("query_idx", "subject_idx")


def find_overlaps(query: DataFrame, subject: DataFrame, *, maxgap: int = -1, minoverlap: int = 0, kind: str = "any", select: str = "all", ignore_strand: bool = False, bins: tuple[int, int] | None = None) -> DataFrame:
    """Pairs, or with ``select`` first, last or arbitrary one row per query with a null where nothing overlaps."""
    options = {"maxgap": maxgap, "minoverlap": minoverlap, "kind": kind, "ignore_strand": ignore_strand, "bins": bins}
    if select == "all":
        return overlap_pairs(query, subject, **options)
    if select not in ("first", "last", "arbitrary"):
        raise ValueError("select is all, first, last or arbitrary")
    one = one_hit(query, subject, select == "last", **options)
    return query.select(F.col("rid").alias("query_idx")).join(one, "query_idx", "left")


def count_overlaps(query: DataFrame, subject: DataFrame, *, maxgap: int = -1, minoverlap: int = 0, kind: str = "any", ignore_strand: bool = False, width: int = WIDTH) -> DataFrame:
    """(query_idx, n_hits) of every query; running sums or counts by coordinate where they decide the predicate, else the join (kind equal with a
    tolerance, within with a gap, edges with ``minoverlap``).

    With ``minoverlap`` of m > 1 only ranges of m bases and more count, and of those an overlap of m is an overlap of ranges that
    end m - 1 bases sooner. A query without a sequence, strand or coordinate overlaps nothing and has its row.
    """
    if kind == "within" and maxgap <= 0:
        return count_within(query, subject, minoverlap, ignore_strand, width)
    if kind in ("start", "end") and minoverlap < 1:
        # Edges as positions: those no further apart than the tolerance.
        return count_overlaps(at_edge(query, kind), at_edge(subject, kind), maxgap=max(maxgap, 0) - 1, ignore_strand=ignore_strand, width=width)
    if kind == "equal" and maxgap <= 0 and minoverlap < 1:
        keys, side = ["seqnames", "start", "end", "side"], (lambda strands: F.lit("*") if ignore_strand else strands)
        per = subject.withColumn("side", side(F.explode(compatible(F.col("strand"))))).groupBy(*keys).agg(F.count("*").alias("n"))
        return query.withColumn("side", side(F.col("strand"))).join(per, keys, "left").select(F.col("rid").alias("query_idx"), F.coalesce("n", F.lit(0)).cast("long").alias("n_hits"))
    if kind == "any" and minoverlap > 1:
        # Two shared bases are an overlap, whatever gap is allowed.
        maxgap = -1
    if kind != "any":
        pairs = overlap_pairs(query, subject, maxgap=maxgap, minoverlap=minoverlap, kind=kind, ignore_strand=ignore_strand)
        found = pairs.groupBy("query_idx").agg(F.count("*").alias("n"))
        return query.select(F.col("rid").alias("query_idx")).join(found, "query_idx", "left").select("query_idx", F.coalesce("n", F.lit(0)).alias("n_hits"))
    g, m = maxgap + 1, max(minoverlap, 1)
    start, end = F.col("start").cast("long"), F.col("end").cast("long")
    key = F.lit("*") if ignore_strand else F.explode(compatible(F.col("strand")))
    s = subject.where(end - start + 1 >= m) if m > 1 else subject
    # Empty subjects are counted apart: an empty query meets none of them.
    void = (end < start).cast("long")
    ends = F.explode(F.array(F.struct(start.alias("pos"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct((end + 1).alias("pos"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    flat = s.select("seqnames", key.alias("side"), "start", "end").select("seqnames", "side", void.alias("void"), ends.alias("e"))
    sums = ["up", "down", "vup", "vdown"]
    changes = flat.groupBy("seqnames", "side", F.col("e.pos").alias("pos")).agg(*[F.sum(((F.col("void") if c[0] == "v" else 1 - F.col("void")) * F.col(f"e.{c.lstrip('v')}"))).alias(c) for c in sums])
    side = F.lit("*") if ignore_strand else F.col("strand")
    # With minoverlap the ask moves m - 1 bases inwards at both ends.
    asks = query.select(F.col("rid").alias("query_idx"), "seqnames", side.alias("side"), (start - g + m - 1).alias("lo"), (end + g - m + 1).alias("hi"), (end - start + 1 >= m).alias("wide"))
    asks = asks.withColumns({"__lo": bin_of(F.col("lo"), width), "__hi": bin_of(F.col("hi"), width)})
    keys = ["seqnames", "side"]
    # Written once, read for both ends: a table of known size, which Spark broadcasts where it is small.
    bins = written(sums_by_bin(changes, asked_bins(asks.withColumn("__bin", F.explode(F.array("__lo", "__hi"))), keys=keys), keys, sums, width))

    def seen(rows: DataFrame, at: str, name: str, plain: str, voids: str) -> DataFrame:
        """``rows`` with the sums of ``plain`` and ``voids`` up to the position ``at``."""
        here = bins.select(*keys, F.col("__bin").alias(f"__{at}"), "places", *[c for n in (plain, voids) for c in (n, f"before_{n}")])
        k = upto(F.col("places"), F.col(at))
        out = rows.join(here, [*keys, f"__{at}"], "left").withColumn("k", k)
        value = lambda n: F.coalesce(F.col(f"before_{n}") + F.when(F.col("k") > 0, F.get(n, F.col("k") - 1)).otherwise(0), F.lit(0))
        return out.withColumn(name, value(plain) + F.when(F.col("hi") >= F.col("lo"), value(voids)).otherwise(0)).drop("places", "k", *[c for n in (plain, voids) for c in (n, f"before_{n}")])

    found = seen(seen(asks, "hi", "begun", "up", "vup"), "lo", "ended", "down", "vdown")
    asked = F.col("lo").isNotNull() & F.col("hi").isNotNull() & (F.col("wide") if m > 1 else F.lit(True))
    return found.select("query_idx", F.when(asked, F.col("begun") - F.col("ended")).otherwise(0).cast("long").alias("n_hits"))


def count_within(query: DataFrame, subject: DataFrame, minoverlap: int, ignore_strand: bool, width: int) -> DataFrame:
    """(query_idx, n_hits): how many subjects start no later and end no sooner than each query; no pairs.

    Of the starts up to a query's, ends before its own are taken off, both running sums; a subject strictly inside the query was taken off without
    having been counted, and is added again. Only queries with both a start and an end inside ask for those: the starts behind their own are a few
    blocks of 1, 4, 16, ... bases, as large as the widest of these queries at most, and in each they look up how many ends lie before theirs.
    """
    start, end = F.col("start").cast("long"), F.col("end").cast("long")
    keys, blocks, sums = ["seqnames", "side"], ["seqnames", "side", "level", "block"], ["up", "down"]
    s = subject.where("start is not null and end is not null")
    s = s.select("seqnames", (F.lit("*") if ignore_strand else F.explode(compatible(F.col("strand")))).alias("side"), start.alias("at"), end.alias("pos"))
    ends = F.explode(F.array(F.struct(F.col("at").alias("pos"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct("pos", F.lit(0).alias("up"), F.lit(1).alias("down"))))
    changes = s.select(*keys, ends.alias("e")).groupBy(*keys, F.col("e.pos").alias("pos")).agg(*[F.sum(f"e.{c}").alias(c) for c in sums])
    asks = query.select(F.col("rid").alias("query_idx"), "seqnames", (F.lit("*") if ignore_strand else F.col("strand")).alias("side"), start.alias("lo"), end.alias("hi"))
    asks = asks.withColumns({"__lo": bin_of(F.col("lo"), width), "__hi": bin_of(F.col("hi"), width)})
    bins = written(sums_by_bin(changes, asked_bins(asks.withColumn("__bin", F.explode(F.array("__lo", "__hi"))), keys), keys, sums, width))

    def seen(rows: DataFrame, *edges: str) -> DataFrame:
        """``rows`` with the starts up to each of these edges, which share a bin, and the ends before it."""
        out = rows.join(bins.withColumnRenamed("__bin", f"__{edges[0]}"), [*keys, f"__{edges[0]}"], "left")
        for edge in edges:
            out = out.withColumn("k", upto(F.col("places"), F.col(edge)))
            before = F.col("k") - F.coalesce((F.get("places", F.col("k") - 1) == F.col(edge)).cast("int"), F.lit(0))
            value = lambda n, k: F.coalesce(F.col(f"before_{n}") + F.when(k > 0, F.get(n, k - 1)).otherwise(0), F.lit(0))
            out = out.withColumns({f"up_{edge}": value("up", F.col("k")), f"down_{edge}": value("down", before)})
        return out.drop("places", "k", *sums, *[f"before_{c}" for c in sums])

    # Most queries lie in one bin, and are moved once.
    near = seen(asks.where("__lo <=> __hi").drop("__hi"), "lo", "hi")
    counted = near.drop("__lo").unionByName(seen(seen(asks.where("not (__lo <=> __hi)"), "lo"), "hi").drop("__lo", "__hi"))
    asked = F.col("lo").isNotNull() & F.col("hi").isNotNull() & (F.col("hi") - F.col("lo") + 1 >= minoverlap if minoverlap > 0 else F.lit(True))
    inside = asked & (F.col("up_hi") > F.col("up_lo")) & (F.col("down_hi") > F.col("down_lo"))
    # Written once: most of it is the result, some of it asks again.
    first = written(counted.select("query_idx", F.when(asked, F.col("up_lo") - F.col("down_hi")).otherwise(0).cast("long").alias("n"), *[F.when(inside, F.col(c)).alias(c) for c in (*keys, "lo", "hi")]))
    again, done = first.where("lo is not null"), first.where("lo is null").select("query_idx", F.col("n").alias("n_hits"))
    most = again.agg(F.max(F.col("hi") - F.col("lo") + 1)).first()[0]
    if most is None:
        return done
    top = level_of(most)
    apart = s.where(F.col("pos") - F.col("at") + 3 <= most).groupBy(*keys, "at", "pos").agg(F.count("*").alias("n"))
    nodes = apart.select(*keys, "pos", "n", F.explode(F.expr(around("at", top))).alias("x")).select(*keys, "pos", "n", "x.*")
    asks = again.withColumn("next", F.col("lo") + 1).select("query_idx", *keys, (F.col("hi") - 1).alias("ask"), F.explode(F.expr(made_up_of("next", "hi", top))).alias("x"))
    asks = asks.select("query_idx", *keys, "ask", "x.*").withColumn("__bin", bin_of(F.col("ask"), width))
    # Only the blocks that some query asks are held.
    held = written(nodes.join(asks.select(*blocks).distinct(), blocks, "left_semi").groupBy(*blocks, "pos").agg(F.sum("n").alias("n")))
    found = asks.join(sums_by_bin(held, asked_bins(asks, blocks), blocks, ["n"], width), [*blocks, "__bin"])
    k = upto(F.col("places"), F.col("ask"))
    found = found.select("query_idx", (F.col("before_n") + F.when(k > 0, F.get("n", k - 1)).otherwise(0)).alias("n"))
    return again.select("query_idx", "n").unionByName(found).groupBy("query_idx").agg(F.sum("n").alias("n_hits")).unionByName(done)


def overlaps_any(query: DataFrame, subject: DataFrame, **options) -> DataFrame:
    """(query_idx, overlaps) of every query."""
    return count_overlaps(query, subject, **options).select("query_idx", (F.col("n_hits") > 0).alias("overlaps"))


def subset_by_overlaps(x: DataFrame, ranges: DataFrame, invert: bool = False, **options) -> DataFrame:
    """The rows of ``x`` that overlap (or, inverted, do not); metadata stay."""
    hit = overlaps_any(x, ranges, **options).where("overlaps").select(F.col("query_idx").alias("rid"))
    return x.join(hit, "rid", "left_anti" if invert else "left_semi")


def match(x: DataFrame, table: DataFrame, nomatch: int | None = None, ignore_strand: bool = False) -> DataFrame:
    """(rid, match): the least place in ``table`` of an equal range, else ``nomatch``."""
    keys = ["seqnames", "start", "end"] + ([] if ignore_strand else ["strand"])
    first = table.groupBy(*keys).agg(F.min("rid").alias("match"))
    out = x.select("rid", *keys).join(first, keys, "left")
    return out.select("rid", F.coalesce("match", F.lit(nomatch).cast("long")).alias("match"))
