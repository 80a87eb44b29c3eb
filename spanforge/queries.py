"""One query per operator over the test tables, each with the SQL of an independent engine."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.core import Ranges, RangesList
from spanforge.operators import intra, lists, merge, nearest, order, overlaps, pairwise, tiling
from spanforge.plans.storage import own_dir
from spanforge.views import VIEWS, ev, lg, li, pt, py, si, table

Query = Callable[[SparkSession, str], DataFrame]
ROW = ["rid", "seqnames", "start", "end", "strand"]
SPAN = ["seqnames", "start", "end", "strand"]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, query: Query, sql: str) -> None:
    QUERIES[name] = query
    SQL[name] = sql if sql.lstrip().upper().startswith("WITH") else f"WITH {VIEWS}\n{sql}"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sequence and strand of the event: line items in a window that overlap an event."""
    q, s = intra.restrict(li(spark, sf_dir), 1, 120000), ev(spark, sf_dir)
    pairs = overlaps.find_overlaps(q, s)
    return pairs.join(s.select(F.col("rid").alias("subject_idx"), "seqnames", "strand"), "subject_idx").groupBy("seqnames", "strand").agg(F.count("*").alias("n_pairs"), F.countDistinct("query_idx").alias("n_items"))


OVERLAP = """FROM {q} q JOIN ev s ON q.seqnames = s.seqnames AND q.start - {g} <= s."end" AND q."end" + {g} >= s.start{more}"""
ANY_STRAND = " AND (q.strand = s.strand OR q.strand = '*' OR s.strand = '*')"


def hits(g: int = 0, more: str = ANY_STRAND, q: str = "li") -> str:
    return OVERLAP.format(q=q, g=g, more=more)


register("entry_overlap_counts", flagship, f"""
SELECT s.seqnames, s.strand, count(*) AS n_pairs, count(DISTINCT q.rid) AS n_items
{hits(q="(SELECT rid, seqnames, greatest(start, 1) AS start, least(\"end\", 120000) AS \"end\", strand FROM li WHERE least(\"end\", 120000) >= greatest(start, 1))")} GROUP BY ALL""")

# Sources, filters, limits
register("seqlevels", lambda s, d: ev(s, d).select("seqnames").distinct(), "SELECT DISTINCT seqnames FROM ev")
register("filter_chained", lambda s, d: ev(s, d).where("seqnames = 'chr1'").where((F.col("score") > 12) & (F.col("start") >= 100)).select(*ROW), """SELECT rid, seqnames, start, "end", strand FROM ev WHERE seqnames = 'chr1' AND score > 12 AND start >= 100""")
register("head_n", lambda s, d: order.head(ev(s, d), 10).select(*ROW), """SELECT rid, seqnames, start, "end", strand FROM ev ORDER BY rid LIMIT 10""")
register("tail_n", lambda s, d: order.tail(ev(s, d), 10).select(*ROW), """SELECT rid, seqnames, start, "end", strand FROM ev ORDER BY rid DESC LIMIT 10""")
register("head_negative", lambda s, d: order.head(ev(s, d), -3).select(*ROW), """SELECT rid, seqnames, start, "end", strand FROM ev WHERE rid <= (SELECT count(*) - 3 FROM ev)""")
register("tail_negative", lambda s, d: order.tail(ev(s, d), -3).select(*ROW), """SELECT rid, seqnames, start, "end", strand FROM ev WHERE rid > 3""")
register("take_after_filter", lambda s, d: order.take(ev(s, d).where("seqnames = 'chr2'"), [1, 2, 3, 7]).select(*ROW), """SELECT rid, seqnames, start, "end", strand FROM (SELECT *, row_number() OVER (ORDER BY rid) AS k FROM ev WHERE seqnames = 'chr2') WHERE k IN (1, 2, 3, 7)""")
PICKED = """SELECT t.k AS rid, seqnames, start, "end", strand FROM (SELECT *, row_number() OVER (ORDER BY rid) AS spot FROM ev WHERE seqnames = 'chr2') e JOIN {wanted} ON e.spot = t.spot"""
chr2 = lambda s, d: Ranges(ev(s, d).where("seqnames = 'chr2'"))
register("positions_in_order", lambda s, d: chr2(s, d)[[7, 1, 1, 3]].df.select(*ROW), PICKED.format(wanted="(VALUES (7, 1), (1, 2), (1, 3), (3, 4)) AS t(spot, k)"))
register("positions_left_out", lambda s, d: chr2(s, d)[[-1, -3]].df.select(*ROW), PICKED.format(wanted="(SELECT spot, row_number() OVER (ORDER BY spot) AS k FROM generate_series(1, 100000) AS g(spot) WHERE spot NOT IN (1, 3)) AS t"))
register("positions_slice", lambda s, d: chr2(s, d)[10:60:7].df.select(*ROW), PICKED.format(wanted="(SELECT 11 + 7 * k AS spot, k + 1 AS k FROM generate_series(0, 7) AS g(k)) AS t"))
register("truth_values", lambda s, d: chr2(s, d)[[True, False, True, True]].df.select(*ROW), PICKED.format(wanted="(VALUES (1, 1), (3, 2), (4, 3)) AS t(spot, k)"))


def opened(s: SparkSession, d: str, key: object = "event_id", dims: DataFrame | None = None) -> Ranges:
    """Events bound by roles: a position and a width, named rows."""
    at = (F.col("event_id") * 15 + 1).cast("int")
    return Ranges.open(s, table(s, d, "events"), seqnames=F.concat(F.lit("chr"), (1 + F.col("user_id") % 6).cast("string")), start=at, width=F.greatest(F.lit(1), F.floor(F.abs("value")).cast("int")), key=key, mcols=["value"], dims=dims)


NAMED = """SELECT {rid} AS rid, e.rid - 1 AS event_id, seqnames, start, "end", '*' AS strand, score AS value FROM ev e"""
NAMES = ["rid", "event_id", "seqnames", "start", "end", "strand", "value"]
register("open_by_roles", lambda s, d: opened(s, d).df.select(*NAMES), NAMED.format(rid="e.rid"))
register("open_in_key_order", lambda s, d: opened(s, d, ["event_id", [40, 3, 700]]).df.select(*NAMES), NAMED.format(rid="t.k") + " JOIN (VALUES (40, 1), (3, 2), (700, 3)) AS t(id, k) ON e.rid - 1 = t.id")
register("open_with_dimension", lambda s, d: opened(s, d).with_dims(table(s, d, "events").where("event_type = 'click'").select("event_id")).df.select(*NAMES), NAMED.format(rid="e.rid") + " WHERE strand = '+'")
register("metadata_set", lambda s, d: opened(s, d).with_mcols({"double": F.col("value") * 2}).mcols.select("rid", "double"), "SELECT rid, score * 2 AS double FROM ev")
register("ranges_only", lambda s, d: opened(s, d).ranges(), 'SELECT rid, start, "end", "end" - start + 1 AS width FROM ev')
register("seqinfo_set", lambda s, d: opened(s, d).with_seqlengths({"chr5": 7, "chr9": 3}).with_circular({"chr1": True}).with_genome("g1").seqinfo, "SELECT DISTINCT seqnames, CASE seqnames WHEN 'chr5' THEN 7 END AS seqlength, CASE seqnames WHEN 'chr1' THEN true END AS is_circular, 'g1' AS genome FROM ev")


def stored(s: SparkSession, d: str, kind: str) -> DataFrame:
    """Events written by roles and opened again: a folder by sequence, text files, or a table of the catalog."""
    at, raw = f"{own_dir(s)}/s-{uuid.uuid4().hex}", opened(s, d)
    roles = {"seqnames": "seqnames", "start": "start", "end": "end", "strand": "strand", "key": "event_id", "mcols": ["value"]}
    if kind == "csv":
        raw.df.write.csv(f"{at}.csv", header=True, compression="gzip")
        return Ranges.open(s, f"{at}.csv", **roles, order=["rid"]).df.select(*NAMES)
    if kind == "view":
        raw.df.drop("rid").createOrReplaceTempView("ranges_of_events")
        return Ranges.open(s, "table:ranges_of_events", **roles).df.select(*NAMES)
    raw.write(at, "seqnames")
    return Ranges.open(s, at, **roles).df.select(*NAMES)


for kind in ("csv", "view", "parquet"):
    register(f"open_stored_{kind}", lambda s, d, k=kind: stored(s, d, k), NAMED.format(rid="e.rid"))
register("names_of_rows", lambda s, d: opened(s, d).names(), "SELECT rid, rid - 1 AS event_id FROM ev")
register("widths", lambda s, d: ev(s, d).select("rid", (F.col("end") - F.col("start") + 1).alias("width")), """SELECT rid, "end" - start + 1 AS width FROM ev""")

# Each range alone
MINUS = "strand = '-'"


def alone(name: str, fn: Callable[[DataFrame], DataFrame], lo: str, hi: str, where: str = "", view: str = "li") -> None:
    frame = {"li": li, "ev": ev}[view]
    register(name, lambda s, d: fn(frame(s, d)).select(*ROW), f"""SELECT rid, seqnames, CAST({lo} AS INT) AS start, CAST({hi} AS INT) AS "end", strand FROM {view} {where}""")


def by_strand(plus: str, minus: str) -> str:
    return f"CASE WHEN {MINUS} THEN {minus} ELSE {plus} END"


alone("shift", lambda x: intra.shift(x, 17), "start + 17", '"end" + 17')
alone("narrow_start", lambda x: intra.narrow(x, start=2), "start + 1", '"end"')
alone("narrow_end_neg", lambda x: intra.narrow(x, end=-1, width=1), '"end"', '"end"')
alone("resize_start", lambda x: intra.resize(x, 25, "start"), by_strand("start", '"end" - 24'), by_strand("start + 24", '"end"'))
alone("resize_end", lambda x: intra.resize(x, 25, "end"), by_strand('"end" - 24', "start"), by_strand('"end"', "start + 24"))
alone("resize_center", lambda x: intra.resize(x, 25, "center"), 'start + floor(("end" - start + 1 - 25) / 2.0)', 'start + floor(("end" - start + 1 - 25) / 2.0) + 24')
alone("resize_ignore_strand", lambda x: intra.resize(x, 25, "end", True), '"end" - 24', '"end"')
alone("flank_start", lambda x: intra.flank(x, 10), by_strand("start - 10", '"end" + 1'), by_strand("start - 1", '"end" + 10'))
alone("flank_end", lambda x: intra.flank(x, 10, start=False), by_strand('"end" + 1', "start - 10"), by_strand('"end" + 10', "start - 1"))
alone("flank_both", lambda x: intra.flank(x, 10, both=True), by_strand("start - 10", '"end" - 9'), by_strand("start + 9", '"end" + 10'))
alone("flank_end_both", lambda x: intra.flank(x, 10, start=False, both=True), by_strand('"end" - 9', "start - 10"), by_strand('"end" + 10', "start + 9"))
alone("promoters", lambda x: intra.promoters(x, 2000, 200), by_strand("start - 2000", '"end" - 199'), by_strand("start + 199", '"end" + 2000'))
alone("terminators", lambda x: intra.terminators(x, 2000, 200), by_strand('"end" - 2000', "start - 199"), by_strand('"end" + 199', "start + 2000"))
alone("restrict_scalar", lambda x: intra.restrict(x, 500, 60000), "greatest(start, 500)", 'least("end", 60000)', 'WHERE least("end", 60000) >= greatest(start, 500)')
CLIP_LO = 'CASE WHEN least("end", {hi}) >= greatest(start, {lo}) - 1 THEN greatest(start, {lo}) WHEN start > {hi} THEN {hi} + 1 ELSE {lo} END'
CLIP_HI = 'CASE WHEN least("end", {hi}) >= greatest(start, {lo}) - 1 THEN least("end", {hi}) WHEN start > {hi} THEN {hi} ELSE {lo} - 1 END'
alone("restrict_keep_all", lambda x: intra.restrict(x, 500, 60000, True), CLIP_LO.format(lo=500, hi=60000), CLIP_HI.format(lo=500, hi=60000))
register("restrict_named", lambda s, d: intra.restrict(li(s, d), {"chr1": 1000, "chr2": 500}, {"chr1": 90000}).select(*ROW), """
SELECT rid, seqnames, CAST(greatest(start, lo) AS INT) AS start, CAST(least("end", hi) AS INT) AS "end", strand
FROM li LEFT JOIN (VALUES ('chr1', 1000, 90000), ('chr2', 500, NULL)) AS b(seqnames, lo, hi) USING (seqnames) WHERE least("end", hi) >= greatest(start, lo)""")
register("trim", lambda s, d: intra.trim(li(s, d), si(s)).select(*ROW), f"""
SELECT rid, seqnames, CAST(CASE WHEN n IS NULL THEN start ELSE {CLIP_LO.format(lo=1, hi="n")} END AS INT) AS start, CAST(CASE WHEN n IS NULL THEN "end" ELSE {CLIP_HI.format(lo=1, hi="n")} END AS INT) AS "end", strand
FROM li LEFT JOIN (SELECT seqnames, seqlength AS n FROM si WHERE NOT is_circular) USING (seqnames)""")

# Overlap joins
PAIRS = "SELECT q.rid AS query_idx, s.rid AS subject_idx"
for name, options, sql in (
    ("find_overlaps", {}, f"{PAIRS} {hits()}"),
    ("find_overlaps_ignore_strand", {"ignore_strand": True}, f"{PAIRS} {hits(more='')}"),
    ("find_overlaps_maxgap", {"maxgap": 10}, f"{PAIRS} {hits(11)}"),
    ("find_overlaps_minoverlap", {"minoverlap": 8}, f"""{PAIRS} {hits(more=ANY_STRAND + ' AND least(q."end", s."end") - greatest(q.start, s.start) + 1 >= 8')}"""),
    ("find_overlaps_within", {"kind": "within"}, f"""{PAIRS} {hits(more=ANY_STRAND + ' AND q.start >= s.start AND q."end" <= s."end"')}"""),
    ("find_overlaps_start", {"kind": "start", "maxgap": 2}, f"""{PAIRS} {hits(3, ANY_STRAND + ' AND abs(q.start - s.start) <= 2')}"""),
    ("find_overlaps_end", {"kind": "end"}, f"""{PAIRS} {hits(more=ANY_STRAND + ' AND q."end" = s."end"')}"""),
    ("find_overlaps_equal", {"kind": "equal"}, f"""{PAIRS} {hits(more=ANY_STRAND + ' AND q.start = s.start AND q."end" = s."end"')}"""),
    ("find_overlaps_first", {"select": "first"}, f"SELECT li.rid AS query_idx, subject_idx FROM li LEFT JOIN (SELECT q.rid, min(s.rid) AS subject_idx {hits()} GROUP BY q.rid) USING (rid)"),
    ("find_overlaps_last", {"select": "last"}, f"SELECT li.rid AS query_idx, subject_idx FROM li LEFT JOIN (SELECT q.rid, max(s.rid) AS subject_idx {hits()} GROUP BY q.rid) USING (rid)"),
):
    register(name, lambda s, d, o=options: overlaps.find_overlaps(li(s, d), ev(s, d), **o), sql)


def kept_apart(s: SparkSession, d: str) -> str:
    """Events in a table laid out for overlap joins."""
    name = f"ranges_{uuid.uuid4().hex}"
    Ranges(ev(s, d)).store(name, f"{own_dir(s)}/{name}", 8)
    return name


register("find_overlaps_stored", lambda s, d: Ranges(li(s, d)).find_stored(kept_apart(s, d)), f"{PAIRS} {hits()}")
register("find_overlaps_stored_sequences", lambda s, d: Ranges(li(s, d)).find_stored(kept_apart(s, d), sequences=["chr2", "chr4"], maxgap=10), f"{PAIRS} {hits(11)} WHERE q.seqnames IN ('chr2', 'chr4')")
heaped = lambda x, width: x.select("rid", "seqnames", (F.col("start") % 500).alias("start"), (F.col("start") % 500 + width).cast("int").alias("end"), "strand")
#: Ranges folded onto 500 bases, so that each overlaps a large part of all others of its sequence.
HEAPED = """SELECT p.rid AS query_idx, {pick}(e.rid) AS subject_idx FROM (SELECT rid, seqnames, start % 500 AS start FROM pt) p LEFT JOIN
  (SELECT rid, seqnames, start % 500 AS start, start % 500 + "end" - start AS "end" FROM ev) e ON p.seqnames = e.seqnames AND p.start <= e."end" AND p.start + 200 >= e.start GROUP BY p.rid"""
for name, pick in (("first", "min"), ("last", "max")):
    register(f"find_overlaps_{name}_heaped", lambda s, d, n=name: overlaps.find_overlaps(heaped(pt(s, d), 200), heaped(ev(s, d), F.col("end") - F.col("start")), select=n), HEAPED.format(pick=pick))

register("stored_ranges", lambda s, d: Ranges.stored(s, kept_apart(s, d)).df.select(*ROW, "score"), 'SELECT rid, seqnames, start, "end", strand, score FROM ev')
COUNTED = "SELECT li.rid AS query_idx, coalesce(n, 0) AS n_hits FROM li LEFT JOIN (SELECT q.rid, count(*) AS n {hits} GROUP BY q.rid) USING (rid)"
register("count_overlaps", lambda s, d: overlaps.count_overlaps(li(s, d), ev(s, d)), COUNTED.format(hits=hits()))
register("count_overlaps_ignore_strand", lambda s, d: overlaps.count_overlaps(li(s, d), ev(s, d), ignore_strand=True, maxgap=5), COUNTED.format(hits=hits(6, "")))
register("count_overlaps_minoverlap", lambda s, d: overlaps.count_overlaps(li(s, d), ev(s, d), minoverlap=8), COUNTED.format(hits=hits(more=ANY_STRAND + ' AND least(q."end", s."end") - greatest(q.start, s.start) + 1 >= 8')))
register("count_overlaps_within", lambda s, d: overlaps.count_overlaps(li(s, d), ev(s, d), kind="within", minoverlap=2), COUNTED.format(hits=hits(more=ANY_STRAND + ' AND q.start >= s.start AND q."end" <= s."end" AND q."end" - q.start + 1 >= 2')))
for name, options, g, more in (
    ("start", {"kind": "start", "maxgap": 2}, 3, " AND abs(q.start - s.start) <= 2"),
    ("end", {"kind": "end"}, 0, ' AND q."end" = s."end"'),
    ("equal", {"kind": "equal"}, 0, ' AND q.start = s.start AND q."end" = s."end"'),
    ("gap_minoverlap", {"maxgap": 3, "minoverlap": 8}, 0, ' AND least(q."end", s."end") - greatest(q.start, s.start) + 1 >= 8'),
):
    register(f"count_overlaps_{name}", lambda s, d, o=options: overlaps.count_overlaps(li(s, d), ev(s, d), **o), COUNTED.format(hits=hits(g, ANY_STRAND + more)))
register("overlaps_any", lambda s, d: overlaps.overlaps_any(li(s, d), ev(s, d)), f"SELECT rid AS query_idx, rid IN (SELECT q.rid {hits()}) AS overlaps FROM li")
for name, invert in (("subset_by_overlaps", False), ("subset_by_overlaps_invert", True)):
    register(name, lambda s, d, i=invert: overlaps.subset_by_overlaps(li(s, d), ev(s, d), i).select(*ROW, "score"), f"""SELECT rid, seqnames, start, "end", strand, score FROM li WHERE rid {'NOT ' if invert else ''}IN (SELECT q.rid {hits()})""")


def shrunk(df: DataFrame) -> DataFrame:
    """Ranges of few distinct places, so that equal ones exist."""
    lo = (F.floor(F.col("start") / 50) * 50 + 1).cast("int")
    return df.withColumns({"start": lo, "end": (lo + F.col("rid") % 3).cast("int")})


SHRUNK = """SELECT rid, seqnames, CAST(floor(start / 50.0) * 50 + 1 AS INT) AS start, CAST(floor(start / 50.0) * 50 + 1 + rid % 3 AS INT) AS "end", strand FROM {view}"""
for name, ignore in (("match_exact", False), ("match_ignore_strand", True)):
    register(name, lambda s, d, i=ignore: overlaps.match(shrunk(li(s, d)), shrunk(ev(s, d)), ignore_strand=i), f"""
, a AS ({SHRUNK.format(view="li")}), b AS ({SHRUNK.format(view="ev")}), f AS (SELECT seqnames, start, "end"{'' if ignore else ', strand'}, min(rid) AS match FROM b GROUP BY ALL)
SELECT a.rid, match FROM a LEFT JOIN f USING (seqnames, start, "end"{'' if ignore else ', strand'})""")

MEMORY = [("chr1", 100, 900, "+"), ("chr2", 5000, 5001, "*"), ("chr9", 1, 10, "*"), ("chr3", 40000, 60000, "-")]
HELD = "mem AS (SELECT * FROM (VALUES " + ", ".join(f"({k + 1}, '{c}', {a}, {b}, '{x}')" for k, (c, a, b, x) in enumerate(MEMORY)) + """) AS t(rid, seqnames, start, "end", strand))"""
held = lambda s: Ranges.from_rows(s, MEMORY, names=["a", "b", "c", "d"])
register("overlaps_of_memory", lambda s, d: held(s).find_overlaps(Ranges(ev(s, d))), f", {HELD} {PAIRS} {hits(q='mem')}")
register("overlaps_with_memory", lambda s, d: Ranges(li(s, d)).count_overlaps(held(s)), f", {HELD} " + COUNTED.format(hits=hits().replace("JOIN ev s", "JOIN mem s")))
register("find_overlaps_with_memory", lambda s, d: Ranges(li(s, d)).find_overlaps(held(s)), f", {HELD} {PAIRS} {hits().replace('JOIN ev s', 'JOIN mem s')}")


def uploaded(s: SparkSession, d: str) -> Ranges:
    """The first events as ranges in memory, by names."""
    rows = ev(s, d).where("rid <= 20").orderBy("rid").collect()
    return Ranges.from_rows(s, [tuple(r[c] for c in SPAN[:3]) + (r["strand"],) for r in rows], names=[f"n{r['rid']}" for r in rows])


register("memory_names", lambda s, d: uploaded(s, d).find_overlaps(Ranges(li(s, d))).withColumnRenamed("query_idx", "rid").join(uploaded(s, d).names(), "rid").select("name", "subject_idx"), f"SELECT 'n' || q.rid AS name, s.rid AS subject_idx {hits(q='ev').replace('JOIN ev s', 'JOIN li s')} WHERE q.rid <= 20")

# Neighbours
FORWARD = "(VALUES ('+', '+'), ('+', '*'), ('*', '+'), ('*', '*')) AS k(strand, side)"
BACKWARD = "(VALUES ('-', '-'), ('-', '*'), ('*', '-')) AS k(strand, side)"
BOTH = "(VALUES ('+', '+'), ('+', '*'), ('-', '-'), ('-', '*'), ('*', '+'), ('*', '-'), ('*', '*')) AS k(strand, side)"


def directed_sql(x: str, right: bool) -> str:
    """Candidates (rid, side, pos, dist, low, high, pass) of one direction."""
    def one(at: str, keys: str, right: bool, tag: int) -> str:
        place, dist = ('x."end" < f.pos', 'f.pos - x."end"') if right else ("x.start > f.pos", "x.start - f.pos")
        return f"""SELECT x.rid, x.seqnames, f.side, f.pos, {dist} AS dist, low, high, {tag} AS pass FROM {x} x ASOF JOIN (SELECT seqnames, side, {at} AS pos, min(rid) AS low, max(rid) AS high FROM ev JOIN {keys} USING (strand) GROUP BY ALL) f
  ON x.seqnames = f.seqnames AND x.strand = f.side AND {place}"""
    a, b = ("start", '"end"') if right else ('"end"', "start")
    return one(a, FORWARD, right, 1) + " UNION ALL " + one(b, BACKWARD, not right, 2)


def directed_query(right: bool, every: bool, x: str = "li") -> str:
    c = f", c AS ({directed_sql(x, right)}), b AS (SELECT c.* FROM c JOIN (SELECT rid, min(dist) AS dist FROM c GROUP BY rid) USING (rid, dist))"
    if not every:
        pick = "min(low)" if right else "max(high)"
        return c + f" SELECT {x}.rid AS query_idx, subject_idx FROM {x} LEFT JOIN (SELECT rid, {pick} AS subject_idx FROM b GROUP BY rid) USING (rid)"
    a, z = ("start", '"end"') if right else ('"end"', "start")
    return c + f""" SELECT b.rid AS query_idx, s.rid AS subject_idx FROM b JOIN ev s ON b.seqnames = s.seqnames AND ((pass = 1 AND s.{a} = b.pos AND (s.strand, b.side) IN (SELECT strand, side FROM {FORWARD})) OR (pass = 2 AND s.{z} = b.pos AND (s.strand, b.side) IN (SELECT strand, side FROM {BACKWARD})))"""


register("precede_first", lambda s, d: nearest.precede(li(s, d), ev(s, d)), directed_query(True, False))
register("precede_all", lambda s, d: nearest.precede(li(s, d), ev(s, d), "all"), directed_query(True, True))
register("follow_last", lambda s, d: nearest.follow(li(s, d), ev(s, d)), directed_query(False, False))
register("follow_all", lambda s, d: nearest.follow(li(s, d), ev(s, d), "all"), directed_query(False, True))


register("precede_self", lambda s, d: nearest.precede(ev(s, d)), directed_query(True, False, "ev"))
register("follow_self", lambda s, d: nearest.follow(ev(s, d)), directed_query(False, False, "ev"))


def near_sql(x: str, apart: str = "", y: str = "ev") -> str:
    """(rid, dist, subject): touching pairs at 0, and every subject at the closest coordinate on either side."""
    touch = f"""SELECT q.rid, 0 AS dist, s.rid AS subject FROM {x} q JOIN {y} s ON q.seqnames = s.seqnames AND q.start - 1 <= s."end" AND q."end" + 1 >= s.start{ANY_STRAND}{apart}"""

    def side(right: bool) -> str:
        at, place, dist = ("start", 'x."end" + 1 < f.pos', 'f.pos - x."end" - 1') if right else ('"end"', "x.start - 1 > f.pos", "x.start - f.pos - 1")
        return f"""SELECT z.rid, z.dist, s.rid AS subject FROM (SELECT x.rid, x.seqnames, x.strand, f.pos, {dist} AS dist FROM {x} x ASOF JOIN (SELECT DISTINCT seqnames, side, {at} AS pos FROM {y} JOIN {BOTH} USING (strand)) f
  ON x.seqnames = f.seqnames AND x.strand = f.side AND {place}) z JOIN {y} s ON z.seqnames = s.seqnames AND s.{at} = z.pos AND (z.strand = s.strand OR z.strand = '*' OR s.strand = '*')"""
    return f", n AS ({touch} UNION ALL {side(True)} UNION ALL {side(False)}), m AS (SELECT rid, min(dist) AS dist FROM n GROUP BY rid), w AS (SELECT n.* FROM n JOIN m USING (rid, dist))"


ONE_NEAR = "SELECT rid, min(subject) AS subject_idx FROM w GROUP BY rid"
register("nearest_one", lambda s, d: nearest.nearest(li(s, d), ev(s, d)), near_sql("li") + f" SELECT li.rid AS query_idx, subject_idx FROM li LEFT JOIN ({ONE_NEAR}) USING (rid)")
register("nearest_all", lambda s, d: nearest.nearest(li(s, d), ev(s, d), "all"), near_sql("li") + " SELECT rid AS query_idx, subject AS subject_idx FROM w")
register("nearest_self", lambda s, d: nearest.nearest(ev(s, d)), near_sql("ev", " AND q.rid <> s.rid") + f" SELECT ev.rid AS query_idx, subject_idx FROM ev LEFT JOIN ({ONE_NEAR}) USING (rid)")
register("distance_to_nearest", lambda s, d: nearest.distance_to_nearest(li(s, d), ev(s, d)), near_sql("li") + " SELECT rid AS query_idx, min(subject) AS subject_idx, CAST(min(dist) AS BIGINT) AS distance FROM w GROUP BY rid")
register("distance_to_nearest_points", lambda s, d: nearest.distance_to_nearest(pt(s, d), ev(s, d), "all"), near_sql("pt") + " SELECT rid AS query_idx, subject AS subject_idx, CAST(dist AS BIGINT) AS distance FROM w")

# Pairs by place
PAIR = """, p AS (SELECT x.rid, x.seqnames, x.strand, x.start AS xs, x."end" AS xe, y.start AS ys, y."end" AS ye, x.strand = y.strand OR x.strand = '*' OR y.strand = '*' AS ok FROM ev x JOIN py y USING (rid))
SELECT rid, {cols} FROM p{where}"""


def pair(name: str, fn: Callable[[DataFrame, DataFrame], DataFrame], lo: str, hi: str, where: str = "") -> None:
    register(name, lambda s, d: fn(ev(s, d), py(s, d)).select(*ROW), PAIR.format(cols=f'seqnames, CAST({lo} AS INT) AS start, CAST({hi} AS INT) AS "end", strand', where=where))


HIT = "least(xe, ye) >= greatest(xs, ys)"
pair("punion_fill", lambda x, y: pairwise.punion(x, y, fill_gap=True), "least(xs, ys)", "greatest(xe, ye)")
pair("pintersect", pairwise.pintersect, f"CASE WHEN ok AND {HIT} THEN greatest(xs, ys) ELSE xs END", f"CASE WHEN ok AND {HIT} THEN least(xe, ye) ELSE xs - 1 END")
pair("pintersect_drop", lambda x, y: pairwise.pintersect(x, y, drop_nohit=True), "greatest(xs, ys)", "least(xe, ye)", f" WHERE ok AND {HIT}")
pair("psetdiff", pairwise.psetdiff, f"CASE WHEN ok AND {HIT} AND NOT (ys <= xs AND ye >= xe) AND ys <= xs THEN ye + 1 ELSE xs END", f"CASE WHEN ok AND {HIT} AND ys <= xs AND ye >= xe THEN xs - 1 WHEN ok AND {HIT} AND ys > xs THEN ys - 1 ELSE xe END")
pair("pgap", pairwise.pgap, "least(xe, ye) + 1", "greatest(greatest(xs, ys) - 1, least(xe, ye))")
register("distance_pairwise", lambda s, d: pairwise.distance(ev(s, d), py(s, d)), PAIR.format(cols="CASE WHEN ok THEN greatest(greatest(xs, ys) - least(xe, ye) - 1, 0) END AS distance", where=""))

# Merging and sweeping
def merged_sql(source: str, gap: int = 1) -> str:
    return f"""SELECT seqnames, min(start) AS start, max("end") AS "end", strand FROM (SELECT *, sum(f) OVER (PARTITION BY seqnames, strand ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS c
  FROM (SELECT *, CASE WHEN m IS NULL OR start > m + {gap} THEN 1 ELSE 0 END AS f FROM (SELECT seqnames, strand, start, "end", max("end") OVER (PARTITION BY seqnames, strand ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {source})))
  GROUP BY seqnames, strand, c"""


register("nearest_memory", lambda s, d: held(s).nearest(Ranges(ev(s, d))), f", {HELD}" + near_sql("mem") + f" SELECT mem.rid AS query_idx, subject_idx FROM mem LEFT JOIN ({ONE_NEAR}) USING (rid)")

BARE = """(SELECT seqnames, '*' AS strand, start, "end" FROM {view})"""


def swept_sql(source: str, columns: str = "1 AS n", back: str = "-1 AS n", sums: tuple[str, ...] = ("n",), marks: str = "") -> str:
    """(seqnames, strand, pos, upto, depth_*) of a sweep over ``source``."""
    totals = ", ".join(f"sum({c}) AS {c}" for c in sums)
    depth = ", ".join(f"sum({c}) OVER (PARTITION BY seqnames, strand ORDER BY pos ROWS UNBOUNDED PRECEDING) AS depth_{c}" for c in sums)
    return f"""SELECT * FROM (SELECT seqnames, strand, pos, lead(pos) OVER (PARTITION BY seqnames, strand ORDER BY pos) - 1 AS upto, {depth} FROM (SELECT seqnames, strand, pos, {totals} FROM
  (SELECT seqnames, strand, start AS pos, {columns} FROM {source} UNION ALL SELECT seqnames, strand, "end" + 1 AS pos, {back} FROM {source}{marks}) GROUP BY ALL)) WHERE upto IS NOT NULL"""


flat = lambda fn: lambda s, d: fn(li(s, d, place=False), s, d).select(*SPAN)
register("range_by_strand", flat(lambda x, s, d: merge.span(x)), 'SELECT seqnames, min(start) AS start, max("end") AS "end", strand FROM li GROUP BY seqnames, strand')
register("range_ignore_strand", flat(lambda x, s, d: merge.span(x, True)), """SELECT seqnames, min(start) AS start, max("end") AS "end", '*' AS strand FROM li GROUP BY seqnames""")
register("reduce", flat(lambda x, s, d: merge.reduce(x)), merged_sql("li"))
register("reduce_gapwidth", flat(lambda x, s, d: merge.reduce(x, min_gapwidth=30)), merged_sql("li", 30))
register("reduce_ignore_strand", lambda s, d: merge.reduce(ev(s, d), ignore_strand=True).select(*SPAN), merged_sql(BARE.format(view="ev")))
LINKED = """, r AS ({made}) SELECT r.seqnames, r.start, r."end", r.strand, x.rid AS member FROM r JOIN {view} x ON x.seqnames = r.seqnames AND {strand}x.start >= r.start AND x.start <= r."end" """
register("reduce_links", lambda s, d: merge.reduce_links(li(s, d), min_gapwidth=30), LINKED.format(made=merged_sql("li", 30), view="li", strand="x.strand = r.strand AND "))
register("reduce_links_ignore_strand", lambda s, d: merge.reduce_links(ev(s, d), ignore_strand=True), LINKED.format(made=merged_sql(BARE.format(view="ev")), view="ev", strand=""))
PIECE = 'CAST(pos AS INT) AS start, CAST(upto AS INT) AS "end"'
register("disjoin", flat(lambda x, s, d: merge.disjoin(x)), f"SELECT seqnames, {PIECE}, strand FROM ({swept_sql('li')}) WHERE depth_n > 0")
register("disjoin_ignore_strand", lambda s, d: merge.disjoin(ev(s, d), True).select(*SPAN), f"SELECT seqnames, {PIECE}, strand FROM ({swept_sql(BARE.format(view='ev'))}) WHERE depth_n > 0")

register("disjoin_links", lambda s, d: merge.disjoin_links(ev(s, d)), f', r AS (SELECT seqnames, {PIECE}, strand FROM ({swept_sql("ev")}) WHERE depth_n > 0) SELECT r.*, x.rid AS member FROM r JOIN ev x ON x.seqnames = r.seqnames AND x.strand = r.strand AND x.start <= r.start AND x."end" >= r."end"')


def gaps_sql(view: str, strands: str, lo: str = "1", hi: str = "seqlength") -> str:
    bounds = f"bd AS (SELECT seqnames, strand, lo, hi FROM (SELECT seqnames, {lo} AS lo, {hi} AS hi FROM si), (VALUES {strands}) AS t(strand) WHERE lo IS NOT NULL AND hi >= lo)"
    source = view if len(strands) > 6 else BARE.format(view=view)
    marks = " UNION ALL SELECT seqnames, strand, lo, 0 FROM bd UNION ALL SELECT seqnames, strand, hi + 1, 0 FROM bd"
    # Stretches without depth, cut to the bounds; neighbours (split by a bound only) do not occur inside.
    return f", {bounds}, sw AS ({swept_sql(source, marks=marks)}) SELECT seqnames, CAST(greatest(pos, lo) AS INT) AS start, CAST(least(upto, hi) AS INT) AS \"end\", strand FROM sw JOIN bd USING (seqnames, strand) WHERE depth_n = 0 AND least(upto, hi) >= greatest(pos, lo)"


register("gaps", flat(lambda x, s, d: merge.gaps(x, si(s))), gaps_sql("li", "('+'), ('-'), ('*')"))
register("gaps_ignore_strand", lambda s, d: merge.gaps(ev(s, d), si(s), ignore_strand=True).select(*SPAN), gaps_sql("ev", "('*')"))
register("gaps_bounds_by_sequence", flat(lambda x, s, d: merge.gaps(x, si(s), {"chr1": 500, "chr2": 70}, {"chr1": 50000, "chr2": 90000})), gaps_sql("li", "('+'), ('-'), ('*')", "CASE seqnames WHEN 'chr1' THEN 500 WHEN 'chr2' THEN 70 END", "CASE seqnames WHEN 'chr1' THEN 50000 WHEN 'chr2' THEN 90000 END"))
register("gaps_bounds", flat(lambda x, s, d: merge.gaps(x, si(s), 500, 50000)), gaps_sql("li", "('+'), ('-'), ('*')", "500", "50000"))


def coverage_sql(view: str, shift: int | str = 0, width: str = "seqlength", weight: str = "1", kind: str = "BIGINT") -> str:
    source = f"""(SELECT seqnames, '*' AS strand, greatest(start + {shift}, 1) AS start, "end" + {shift} AS "end" FROM {view} WHERE "end" + {shift} >= 1)"""
    marks = f" UNION ALL SELECT seqnames, '*', 1, 0 FROM si UNION ALL SELECT seqnames, '*', {width} + 1, 0 FROM si WHERE {width} IS NOT NULL"
    runs = f"""sw AS ({swept_sql(source, f'{weight} AS n', f'-{weight} AS n', marks=marks)}), ct AS (SELECT seqnames, pos AS s, least(upto, {width}) AS e, CAST(depth_n AS {kind}) AS depth FROM sw JOIN si USING (seqnames) WHERE {width} IS NULL OR pos <= {width}),
g AS (SELECT *, sum(f) OVER (PARTITION BY seqnames ORDER BY s ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT *, CASE WHEN lag(depth) OVER (PARTITION BY seqnames ORDER BY s) = depth THEN 0 ELSE 1 END AS f FROM ct))"""
    return f", {runs} SELECT seqnames, CAST(min(s) AS INT) AS start, CAST(max(e) AS INT) AS \"end\", CAST(max(e) - min(s) + 1 AS INT) AS width, min(depth) AS depth FROM g GROUP BY seqnames, c"


register("coverage_runs", lambda s, d: merge.coverage(li(s, d, False), si(s)), coverage_sql("li"))
register("coverage_shifted", lambda s, d: merge.coverage(ev(s, d), si(s), shift=-40, width=50000, weight=2), coverage_sql("ev", -40, "50000", "2"))
register("coverage_width_by_sequence", lambda s, d: merge.coverage(ev(s, d), si(s), width={"chr1": 20000, "chr5": 9000}), coverage_sql("ev", 0, "CASE seqnames WHEN 'chr1' THEN 20000 WHEN 'chr5' THEN 9000 ELSE seqlength END"))
register("coverage_shift_by_sequence", lambda s, d: merge.coverage(ev(s, d), si(s), shift={"chr1": -700, "chr2": 33, "chr5": 10**6}), coverage_sql("ev", "CASE seqnames WHEN 'chr1' THEN -700 WHEN 'chr2' THEN 33 WHEN 'chr5' THEN 1000000 ELSE 0 END"))
register("coverage_weighted", lambda s, d: merge.coverage(ev(s, d), si(s), weight=0.5), coverage_sql("ev", 0, "seqlength", "0.5", "DOUBLE"))


def sets_sql(keep: str, bare: bool) -> str:
    a, b = (BARE.format(view=v) if bare else v for v in ("li", "ev"))
    source = f"""(SELECT seqnames, strand, start, "end", 1 AS x, 0 AS y FROM {a} UNION ALL SELECT seqnames, strand, start, "end", 0, 1 FROM {b})"""
    return f", sw AS ({swept_sql(source, 'x, y', '-x, -y', ('x', 'y'))}), kp AS (SELECT seqnames, strand, pos AS start, upto AS \"end\" FROM sw WHERE {keep}) SELECT seqnames, CAST(start AS INT) AS start, CAST(\"end\" AS INT) AS \"end\", strand FROM ({merged_sql('kp')})"


for name, fn, keep in (("union", merge.union, "depth_x + depth_y > 0"), ("intersect", merge.intersect, "depth_x > 0 AND depth_y > 0"), ("setdiff", merge.setdiff, "depth_x > 0 AND depth_y = 0")):
    for suffix, ignore in (("", False), ("_ignore_strand", True)):
        register(f"set_{name}{suffix}", lambda s, d, f=fn, i=ignore: f(li(s, d, False), ev(s, d), ignore_strand=i).select(*SPAN), sets_sql(keep, ignore))

# Order and duplicates
SORTED = 'seqnames, strand, start, "end"'
register("sort_ranges", lambda s, d: Ranges(ev(s, d)).sort().df.select(*ROW, "score"), f'SELECT row_number() OVER (ORDER BY {SORTED}, rid) AS rid, seqnames, start, "end", strand, score FROM ev')
LEVELS = ["chr3", "chr10", "chr2", "chr5"]
LEVELED = ", lv AS (SELECT ev.*, coalesce(k, 9) AS level FROM ev LEFT JOIN (VALUES ('chr3', 0), ('chr10', 1), ('chr2', 2), ('chr5', 3)) AS t(seqnames, k) USING (seqnames))"
register("sort_by_levels", lambda s, d: Ranges(ev(s, d)).sort(level_order=LEVELS).df.select(*ROW), LEVELED + f' SELECT row_number() OVER (ORDER BY level, {SORTED}, rid) AS rid, seqnames, start, "end", strand FROM lv')
register("order_by_levels", lambda s, d: order.order(ev(s, d), decreasing=True, level_order=LEVELS), LEVELED + ' SELECT row_number() OVER (ORDER BY level DESC, seqnames DESC, strand DESC, start DESC, "end" DESC, rid) AS pos, rid FROM lv')
register("rank_by_levels", lambda s, d: order.rank(ev(s, d), "min", ignore_strand=True, level_order=LEVELS), LEVELED + ' SELECT rid, rank() OVER (ORDER BY level, seqnames, start, "end") AS rank FROM lv')
register("order_perm", lambda s, d: order.order(shrunk(ev(s, d))), f", a AS ({SHRUNK.format(view='ev')}) SELECT row_number() OVER (ORDER BY {SORTED}, rid) AS pos, rid FROM a")
register("order_decreasing", lambda s, d: order.order(shrunk(ev(s, d)), decreasing=True), f", a AS ({SHRUNK.format(view='ev')}) SELECT row_number() OVER (ORDER BY seqnames DESC, strand DESC, start DESC, \"end\" DESC, rid) AS pos, rid FROM a")
for name, ties, fn in (("rank_first", "first", f"row_number() OVER (ORDER BY {SORTED}, rid)"), ("rank_min", "min", f"rank() OVER (ORDER BY {SORTED})"), ("rank_dense", "dense", f"dense_rank() OVER (ORDER BY {SORTED})")):
    register(name, lambda s, d, t=ties: order.rank(shrunk(ev(s, d)), t), f", a AS ({SHRUNK.format(view='ev')}) SELECT rid, {fn} AS rank FROM a")
register("is_unsorted", lambda s, d: order.is_unsorted(ev(s, d)), f"SELECT coalesce(bool_or(k > n), false) AS is_unsorted FROM (SELECT row({SORTED}) AS k, lead(row({SORTED})) OVER (ORDER BY rid) AS n FROM ev)")
for name, last in (("duplicated", False), ("duplicated_from_last", True)):
    register(name, lambda s, d, f=last: order.duplicated(shrunk(li(s, d)), f), f", a AS ({SHRUNK.format(view='li')}) SELECT rid, row_number() OVER (PARTITION BY {SORTED} ORDER BY rid{' DESC' if last else ''}) > 1 AS duplicated FROM a")
register("unique_ranges", lambda s, d: order.unique(shrunk(li(s, d))).select(*ROW), f", a AS ({SHRUNK.format(view='li')}) SELECT min(rid) AS rid, seqnames, start, \"end\", strand FROM a GROUP BY ALL")

# One to many, groups
TILED = """SELECT rid, CAST(k AS INT) AS part, seqnames, CAST(start + floor((k - 1) * w / CAST(n AS DOUBLE)) AS INT) AS start, CAST(start + floor(k * w / CAST(n AS DOUBLE)) - 1 AS INT) AS "end", strand FROM (SELECT *, unnest(generate_series(1, n)) AS k FROM (SELECT *, "end" - start + 1 AS w, {n} AS n FROM ev))"""
register("tile_n", lambda s, d: tiling.tile(ev(s, d), n=5), TILED.format(n="5"))
register("tile_width", lambda s, d: tiling.tile(ev(s, d), width=10), TILED.format(n='CAST(greatest(ceil(("end" - start + 1) / 10.0), 1) AS BIGINT)'))
register("sliding_windows", lambda s, d: tiling.sliding_windows(ev(s, d), 20, 10), """SELECT rid, CAST(k + 1 AS INT) AS part, seqnames, CAST(start + k * 10 AS INT) AS start, CAST(least(start + k * 10 + 19, "end") AS INT) AS "end", strand FROM (SELECT *, unnest(generate_series(0, CAST(ceil(greatest("end" - start + 1 - 20, 0) / 10.0) AS BIGINT))) AS k FROM ev)""")
register("list_element_nrows", lambda s, d: lists.element_nrows(lg(s, d), "l_orderkey"), "SELECT l_orderkey, CAST(count(*) AS INT) AS n FROM li GROUP BY l_orderkey")
register("list_get", lambda s, d: lists.get(lg(s, d), "l_orderkey", 7), """SELECT CAST(row_number() OVER (ORDER BY rid) AS INT) AS part, seqnames, start, "end", strand FROM li WHERE l_orderkey = 7""")
groups = lambda s, d: RangesList(lg(s, d), "l_orderkey")
GROUPED = """SELECT {place} AS place, g.l_orderkey, n FROM (SELECT l_orderkey, CAST(count(*) AS INT) AS n, row_number() OVER (ORDER BY l_orderkey) AS spot FROM li GROUP BY l_orderkey) g JOIN {wanted}"""
counted = lambda x: x.df.select("place", "l_orderkey", F.size("seqnames").alias("n"))
register("list_positions", lambda s, d: counted(groups(s, d)[[5, 2, 2]]), GROUPED.format(place="t.k", wanted="(VALUES (5, 1), (2, 2), (2, 3)) AS t(spot, k) ON g.spot = t.spot"))
register("list_columns", lambda s, d: (lambda x: x.df.select("l_orderkey", "strand", x.width.alias("width")))(groups(s, d)), 'SELECT l_orderkey, list(strand ORDER BY rid) AS strand, list("end" - start + 1 ORDER BY rid) AS width FROM li GROUP BY l_orderkey')
register("list_rename", lambda s, d: groups(s, d).rename(table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), (-F.col("o_orderkey")).alias("name"))).element_nrows(), "SELECT CASE WHEN o_orderkey IS NULL THEN l_orderkey ELSE -l_orderkey END AS l_orderkey, CAST(count(*) AS INT) AS n FROM li LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') ON l_orderkey = o_orderkey GROUP BY ALL")
register("list_head_negative", lambda s, d: groups(s, d).head(-5).element_nrows(), "SELECT l_orderkey, CAST(count(*) AS INT) AS n FROM li GROUP BY l_orderkey QUALIFY row_number() OVER (ORDER BY l_orderkey DESC) > 5")
register("list_tail_negative", lambda s, d: groups(s, d).tail(-5).element_nrows(), "SELECT l_orderkey, CAST(count(*) AS INT) AS n FROM li GROUP BY l_orderkey QUALIFY row_number() OVER (ORDER BY l_orderkey) > 5")
register("list_slice", lambda s, d: counted(groups(s, d)[3:9]), GROUPED.format(place="g.spot - 3", wanted="(SELECT 1) ON g.spot BETWEEN 4 AND 9"))
register("list_metadata", lambda s, d: groups(s, d).with_mcols({"n": F.size("seqnames"), "last": F.array_max("end")}).mcols, 'SELECT l_orderkey, CAST(count(*) AS INT) AS n, max("end") AS last FROM li GROUP BY l_orderkey')
register("list_open_dimension", lambda s, d: RangesList.open(s, lg(s, d), "l_orderkey", seqnames="seqnames", start="start", end="end", strand="strand", dims=table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))).element_nrows(), "SELECT l_orderkey, CAST(count(*) AS INT) AS n FROM li WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY l_orderkey")
register("list_unlist", lambda s, d: lists.unlist(lg(s, d), "l_orderkey"), """SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY rid) AS INT) AS part, seqnames, start, "end", strand FROM li""")
register("list_range", lambda s, d: lists.unlist(lists.list_range(lg(s, d), "l_orderkey"), "l_orderkey").drop("part"), """SELECT l_orderkey, seqnames, min(start) AS start, max("end") AS "end", strand FROM li GROUP BY l_orderkey, seqnames, strand""")
register("list_range_ignore_strand", lambda s, d: lists.unlist(lists.list_range(lg(s, d), "l_orderkey", True), "l_orderkey").drop("part"), """SELECT l_orderkey, seqnames, min(start) AS start, max("end") AS "end", '*' AS strand FROM li GROUP BY l_orderkey, seqnames""")
register("metadata_by_dimension", lambda s, d: li(s, d, False).join(table(s, d, "orders").where("o_orderpriority = '1-URGENT'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("seqnames").agg(F.count("*").alias("n")), "SELECT seqnames, count(*) AS n FROM li WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY seqnames")
