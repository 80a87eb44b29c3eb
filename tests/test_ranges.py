"""Operators against plain Python on small random inputs, and the written-out cases."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.core import Ranges, RangesList
from spanforge.operators import intra, lists, merge, nearest, order, overlaps, pairwise, tiling
from spanforge.plans.guards import no_pair_enumeration, plan_text, pushed_filters, stays_in_jvm
from spanforge.plans.ordinals import with_ordinal
from spanforge.sources import io
from tests import brute

ROUNDS = range(4)
LEVELS = {"a": 70, "b": 40, "c": None, "d": 20}


def made(spark, rows, mcols=""):
    return io.from_rows(spark, rows, mcols)


def spans(df):
    return sorted((r["seqnames"], r["start"], r["end"], r["strand"]) for r in df.collect())


def info(spark, lengths=LEVELS, circular=("b",)):
    return spark.createDataFrame([(n, v, n in circular) for n, v in lengths.items()], "seqnames string, seqlength int, is_circular boolean")


def both(seed, empty=True):
    rng = random.Random(seed)
    return brute.random_ranges(rng, 40, empty), brute.random_ranges(rng, 25, empty)


@pytest.mark.parametrize("seed", ROUNDS)
def test_overlaps(spark, seed):
    q, s = both(seed)
    s[0] = ("a", 1, 5000, "*")  # a wide range goes to a higher level
    x, y = made(spark, q), made(spark, s)
    for options in ({}, {"maxgap": 0}, {"maxgap": 4}, {"ignore_strand": True}):
        want = brute.overlap_pairs(q, s, options.get("maxgap", -1), ignore=options.get("ignore_strand", False))
        assert sorted(map(tuple, overlaps.find_overlaps(x, y, **options).collect())) == sorted(want)
        assert sorted(map(tuple, overlaps.find_overlaps(x, y, bins=(4, 6), **options).collect())) == sorted(want)
        counts = {r[0]: r[1] for r in overlaps.count_overlaps(x, y, width=16, **options).collect()}
        assert counts == {i: sum(a == i for a, _ in want) for i in range(1, len(q) + 1)}
        kept = {r["rid"] for r in overlaps.subset_by_overlaps(x, y, **options).collect()}
        assert kept == {a for a, _ in want}
        assert {r["rid"] for r in overlaps.subset_by_overlaps(x, y, invert=True, **options).collect()} == set(counts) - kept
    want = brute.overlap_pairs(q, s, minoverlap=3)
    assert sorted(map(tuple, overlaps.find_overlaps(x, y, minoverlap=3).collect())) == sorted(want)
    first = {r[0]: r[1] for r in overlaps.find_overlaps(x, y, minoverlap=3, select="first").collect()}
    assert first == {i: min((b for a, b in want if a == i), default=None) for i in range(1, len(q) + 1)}


@pytest.mark.parametrize("seed", ROUNDS)
def test_merging(spark, seed):
    q, s = both(seed)
    full = [r for r in q if r[2] >= r[1]]
    x, y = made(spark, q), made(spark, s)
    for gap in (0, 1, 5):
        for ignore in (False, True):
            assert spans(merge.reduce(x, gap, ignore_strand=ignore, width=16)) == brute.reduced(q, gap, ignore)
    for ignore in (False, True):
        assert spans(merge.union(x, y, ignore_strand=ignore, width=16)) == brute.set_operation(q, s, set.union, ignore)
        assert spans(merge.intersect(x, y, ignore, width=16)) == brute.set_operation(q, s, set.intersection, ignore)
        assert spans(merge.setdiff(x, y, ignore, width=16)) == brute.set_operation(q, s, set.difference, ignore)
        cut = spans(merge.disjoin(x, ignore, width=16))
        edges = {(n, "*" if ignore else t, p) for n, a, b, t in full for p in (a, b + 1)}
        assert sorted((n, t, p) for n, a, b, t in cut for p in range(a, b + 1)) == sorted((n, t, p) for (n, t), d in brute.bases(q, ignore).items() for p in d)
        assert all((n, t, a) in edges and (n, t, b + 1) in edges and not any((n, t, p) in edges for p in range(a + 1, b + 1)) for n, a, b, t in cut)
    got = spans(merge.gaps(x, info(spark), width=16))
    covered = brute.bases(q)
    assert got == sorted((n, a, b, t) for n, size in LEVELS.items() if size for t in "+-*" for a, b in brute.stretches(set(range(1, size + 1)) - set(covered.get((n, t), ()))))


@pytest.mark.parametrize("options", [{}, {"shift": 3}, {"shift": -7}, {"width": 30}, {"weight": 2}, {"weight": 0.5}])
def test_coverage(spark, options):
    q, _ = both(9)
    got = merge.coverage(made(spark, q), info(spark), scan_width=16, **options).collect()
    depth = {n: {} for n in LEVELS}
    for n, s, e, _ in q:
        for p in range(max(s + options.get("shift", 0), 1), e + options.get("shift", 0) + 1):
            depth[n][p] = depth[n].get(p, 0) + options.get("weight", 1)
    for n, size in LEVELS.items():
        size = options.get("width", size) or max(depth[n], default=0)
        runs = sorted((r["start"], r["end"], r["depth"]) for r in got if r["seqnames"] == n)
        assert [d for a, b, d in runs for _ in range(a, b + 1)] == [depth[n].get(p, 0) for p in range(1, size + 1)]
        assert all(a[2] != b[2] for a, b in zip(runs, runs[1:], strict=False))


@pytest.mark.parametrize("seed", ROUNDS)
def test_neighbours(spark, seed):
    q, s = both(seed, empty=seed % 2 == 0)
    x, y = made(spark, q), made(spark, s)
    for ignore in (False, True):
        for fn, forward, pick in ((nearest.precede, True, min), (nearest.follow, False, max)):
            want = brute.precede(q, s, ignore, forward)
            assert {r[0]: r[1] for r in fn(x, y, ignore_strand=ignore, width=16).collect()} == {i: pick(want[i][1]) if i in want else None for i in range(1, len(q) + 1)}
            assert sorted(map(tuple, fn(x, y, "all", ignore, width=16).collect())) == sorted((i, j) for i, (_, js) in want.items() for j in js)
        want = brute.nearest(q, s, ignore)
        assert {tuple(r) for r in nearest.distance_to_nearest(x, y, ignore_strand=ignore, width=16).collect()} == {(i, min(js), d) for i, (d, js) in want.items()}
        assert sorted(map(tuple, nearest.distance_to_nearest(x, y, "all", ignore, width=16).collect())) == sorted((i, j, d) for i, (d, js) in want.items() for j in js)
        own = brute.nearest(q, q, ignore, own=True)
        assert {r[0]: r[1] for r in nearest.nearest(x, ignore_strand=ignore, width=16).collect()} == {i: min(own[i][1]) if i in own else None for i in range(1, len(q) + 1)}


def test_intra(spark):
    x = made(spark, [("a", 10, 19, "+"), ("a", 10, 19, "-"), ("b", 5, 4, "*")])
    rows = lambda df: [(r["start"], r["end"]) for r in df.orderBy("rid").collect()]
    assert rows(intra.shift(x, -3)) == [(7, 16), (7, 16), (2, 1)]
    assert rows(intra.narrow(x.where("rid < 3"), start=5)) == [(14, 19)] * 2
    assert rows(intra.narrow(x.where("rid < 3"), end=-5)) == [(10, 15)] * 2
    assert rows(intra.narrow(x.where("rid < 3"), start=5, end=4)) == [(14, 13)] * 2
    assert rows(intra.resize(x, 5, "center"))[:2] == [(12, 16)] * 2
    assert rows(intra.resize(x.where("rid = 3"), 3, "center")) == [(3, 5)]
    assert rows(intra.resize(x, 4))[:2] == [(10, 13), (16, 19)]
    assert rows(intra.flank(x, 3))[:2] == [(7, 9), (20, 22)]
    assert rows(intra.flank(x, 3, both=True))[:2] == [(7, 12), (17, 22)]
    assert rows(intra.promoters(x, 4, 2))[:2] == [(6, 11), (18, 23)]
    assert rows(intra.terminators(x, 4, 2))[:2] == [(15, 20), (9, 14)]
    with pytest.raises(ValueError):
        intra.narrow(x, width=3)
    with pytest.raises(ValueError):
        intra.narrow(x, 1, 2, 3)
    with pytest.raises(ValueError):
        intra.flank(x, -1)
    with pytest.raises(Exception, match="widen or invert"):
        intra.narrow(x, start=1, width=30).collect()


def test_restrict_and_trim(spark):
    x = made(spark, [("a", 50, 120, "+"), ("a", 150, 250, "-"), ("b", 300, 400, "*"), ("c", 150, 250, "*")])
    cut = lambda df: [(r["rid"], r["start"], r["end"]) for r in df.orderBy("rid").collect()]
    assert cut(intra.restrict(x, 100, 200)) == [(1, 100, 120), (2, 150, 200), (4, 150, 200)]
    assert cut(intra.restrict(x, 100, 120, keep_all=True)) == [(1, 100, 120), (2, 121, 120), (3, 121, 120), (4, 121, 120)]
    assert cut(intra.restrict(x, {"a": 100}, {"c": 160})) == [(1, 100, 120), (2, 150, 250), (3, 300, 400), (4, 150, 160)]
    seqs = spark.createDataFrame([("a", 200, False), ("b", 300, True), ("c", None, False)], "seqnames string, seqlength int, is_circular boolean")
    assert cut(intra.trim(x, seqs)) == [(1, 50, 120), (2, 150, 200), (3, 300, 400), (4, 150, 250)]


def test_pairs(spark):
    x = made(spark, [("a", 10, 20, "+"), ("a", 10, 20, "+"), ("a", 10, 20, "+"), ("b", 10, 20, "*"), ("a", 10, 20, "+")])
    y = made(spark, [("a", 15, 25, "+"), ("a", 30, 40, "*"), ("a", 5, 12, "+"), ("a", 10, 20, "*"), ("a", 1, 99, "-")])
    rows = lambda df: [(r["start"], r["end"]) for r in df.orderBy("rid").collect()]
    some = lambda df: df.where("rid <= 3")
    assert rows(pairwise.punion(some(x), some(y), fill_gap=True)) == [(10, 25), (10, 40), (5, 20)]
    assert rows(pairwise.pintersect(x, y)) == [(15, 20), (10, 9), (10, 12), (10, 9), (10, 9)]
    assert rows(pairwise.pintersect(x, y, drop_nohit=True)) == [(15, 20), (10, 12)]
    assert rows(pairwise.pintersect(x, y, ignore_strand=True))[4] == (10, 20)
    assert rows(pairwise.psetdiff(x, y)) == [(10, 14), (10, 20), (13, 20), (10, 20), (10, 20)]
    assert rows(pairwise.pgap(some(x), some(y))) == [(21, 20), (21, 29), (13, 12)]
    assert [r[1] for r in pairwise.distance(x, y).orderBy("rid").collect()] == [0, 9, 0, None, None]
    for bad in (lambda: pairwise.punion(some(x), some(y)), lambda: pairwise.punion(x, y, fill_gap=True), lambda: pairwise.pgap(x, y), lambda: pairwise.psetdiff(made(spark, [("a", 1, 9, "*")]), made(spark, [("a", 3, 5, "*")])), lambda: pairwise.distance(x, some(y))):
        with pytest.raises(Exception, match="USER_RAISED|pair|inside|length"):
            bad().collect()


def test_order(spark):
    rows = [("b", 5, 9, "+"), ("a", 5, 9, "-"), ("a", 5, 9, "*"), ("a", 5, 9, "-"), ("a", 1, 3, "+")]
    x = made(spark, rows)
    assert [r[1] for r in order.order(x).orderBy("pos").collect()] == [3, 5, 2, 4, 1]
    ranks = lambda t: [r[1] for r in order.rank(x, t).orderBy("rid").collect()]
    assert ranks("first") == [5, 3, 1, 4, 2]
    assert ranks("min") == [5, 3, 1, 3, 2]
    assert ranks("dense") == [4, 3, 1, 3, 2]
    assert [r["rid"] for r in order.sort(x, decreasing=True).collect()] == [1, 2, 4, 5, 3]
    assert order.is_unsorted(x).first()[0] and not order.is_unsorted(made(spark, rows[:1])).first()[0]
    same = made(spark, [("a", 1, 2, "+")] * 2)
    assert not order.is_unsorted(same).first()[0] and order.is_unsorted(same, strictly=True).first()[0]
    assert [r[1] for r in order.duplicated(x).orderBy("rid").collect()] == [False, False, False, True, False]
    assert [r[1] for r in order.duplicated(x, True).orderBy("rid").collect()] == [False, True, False, False, False]
    assert sorted(r["rid"] for r in order.unique(x).collect()) == [1, 2, 3, 5]
    assert [r["rid"] for r in order.tail(x, -3).collect()] == [4, 5] and [r["rid"] for r in order.head(x, -9).collect()] == []
    assert [r["rid"] for r in order.take(x.where("rid > 2"), [1, 3]).orderBy("rid").collect()] == [3, 5]
    assert {tuple(r) for r in overlaps.match(x, made(spark, [rows[1], rows[1], rows[0]]), nomatch=-1).collect()} == {(1, 3), (2, 1), (3, -1), (4, 1), (5, -1)}


def test_tiles(spark):
    x = made(spark, [("a", 1, 20, "+"), ("a", 5, 7, "-")])
    assert [(r["rid"], r["start"], r["end"]) for r in tiling.tile(x, n=3).orderBy("rid", "part").collect()] == [(1, 1, 6), (1, 7, 13), (1, 14, 20), (2, 5, 5), (2, 6, 6), (2, 7, 7)]
    assert tiling.sliding_windows(x.where("rid = 1"), 5, 1).count() == 16
    assert tiling.sliding_windows(made(spark, [("a", 1, 100, "*")]), 20, 10).count() == 9
    assert [(r["start"], r["end"]) for r in tiling.tile(x, width=15).where("rid = 1").orderBy("part").collect()] == [(1, 10), (11, 20)]


def test_lists(spark, tmp_path):
    df = spark.createDataFrame([("A", ["c1", "c1", "c2"], [5, 1, 7], [9, 3, 8], ["+", "+", "-"]), ("B", [], [], [], [])], "g string, seqnames array<string>, start array<int>, end array<int>, strand array<string>")
    x = RangesList.open(spark, df, "g", seqnames="seqnames", start="start", end="end", strand="strand")
    assert {tuple(r) for r in x.element_nrows().collect()} == {("A", 3), ("B", 0)}
    assert [(r["start"], r["end"]) for r in x["A"].orderBy("part").collect()] == [(5, 9), (1, 3), (7, 8)]
    spans_ = {r["g"]: list(zip(r["seqnames"], r["strand"], r["start"], r["end"], strict=True)) for r in x.range().df.collect()}
    assert spans_ == {"A": [("c1", "+", 1, 9), ("c2", "-", 7, 8)], "B": []}
    wide = lists.bind_list(df.withColumn("w", F.zip_with("start", "end", lambda a, b: b - a + 1)), "g", seqnames="seqnames", start="start", width="w")
    assert wide.where("g = 'A'").first()["end"] == [9, 3, 8] and wide.where("g = 'A'").first()["strand"] == ["*"] * 3
    assert x.head(-1).df.first()["g"] == "A" and len(x.tail(1)) == 1 and x.take([2]).df.first()["g"] == "B"
    flat = made(spark, [("a", 1, 2, "+"), ("a", 3, 4, "-"), ("b", 5, 6, "*")]).withColumn("k", F.col("seqnames"))
    assert Ranges.of(flat).split("k").element_nrows().count() == 2


def test_open(spark, tmp_path):
    raw = spark.createDataFrame([("x2", "chr2", 100.0, 10, 2.5), ("x1", "chr1", 5.0, 3, 1.5), ("x3", "chr1", 50.0, 4, 3.5)], "id string, chrom string, pos double, w int, score double")
    raw.write.parquet(str(tmp_path / "p"))
    raw.coalesce(1).write.csv(str(tmp_path / "c.csv"), header=True, compression="gzip")
    for path in ("p", "c.csv"):
        x = Ranges.open(spark, str(tmp_path / path), seqnames="chrom", start="pos", width="w", key="id", mcols=["score"])
        assert [(r["rid"], r["id"], r["start"], r["end"], r["strand"]) for r in x.df.orderBy("rid").collect()] == [(1, "x1", 5, 7, "*"), (2, "x2", 100, 109, "*"), (3, "x3", 50, 53, "*")]
    assert x.seqlevels() == ["chr1", "chr2"] and len(x) == 3 and not x.has_row_number()
    assert [r["id"] for r in x[x["score"] > 2][[1, 2]].df.orderBy("rid").collect()] == ["x2", "x3"]
    named = Ranges.open(spark, raw, seqnames="chrom", start="pos", key=["id", ["x3", "x1"]], mcols=["score"], lengths={"chr1": 60, "chr2": None})
    assert [r["id"] for r in named.df.orderBy("rid").collect()] == ["x3", "x1"]
    assert {r["end"] for r in named.with_seqlengths({"chr1": 40}).trim().df.collect()} == {5, 40}
    with pytest.raises(ValueError):
        Ranges.open(spark, raw, seqnames="chrom", start="pos", end="pos", width="w")
    assert "Ranges[" in repr(named) and named.ranges(True).columns == ["rid", "start", "end", "width", "id", "score"]
    one = with_ordinal(raw, [F.col("id")])
    assert [r["rid"] for r in one.orderBy("id").collect()] == [1, 2, 3]
    named.write(str(tmp_path / "out"), "seqnames")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_subsets_keep_the_given_order(spark):
    x = Ranges.from_rows(spark, [("a", 10 * k, 10 * k + 4, "+") for k in range(1, 8)], lengths={"a": 100, "b": None}, names=list("tuvwxyz"), genome="g1")
    ids = lambda r: [(q["rid"], q["name"]) for q in r.df.orderBy("rid").collect()]
    assert ids(x[[3, 1, 1]]) == [(1, "v"), (2, "t"), (3, "t")] and ids(x[["z", "u", "z", "nobody"]]) == [(1, "z"), (2, "u"), (3, "z")]
    assert ids(x[2:6:2]) == [(1, "v"), (2, "x")] and ids(x[5:]) == [(1, "y"), (2, "z")] and ids(x[[False] * 5 + [True, True]]) == [(1, "y"), (2, "z")]
    assert ids(x[[-1, -2, -3, -4, -5]]) == [(1, "y"), (2, "z")] and ids(x[[]]) == []
    assert ids(x[x["start"] > 40][[2, 1]]) == [(1, "y"), (2, "x")]
    with pytest.raises(ValueError):
        x[[1, -1]]
    with pytest.raises(ValueError):
        Ranges(x.df)[["t"]]
    assert [r["rid"] for r in x.sort(decreasing=True).df.orderBy("rid").collect()] == list(range(1, 8)) and ids(x.sort(decreasing=True))[0] == (1, "z")
    y = x.with_circular({"b": True}).with_genome({"a": "g2"}).with_seqlengths({"b": 5})
    assert (y.seqlevels(), y.seqlengths(), y.is_circular(), y.genome()) == (["a", "b"], {"a": 100, "b": 5}, {"a": None, "b": True}, {"a": "g2", "b": "g1"})
    assert repr(y).count("Row(") == 7 and "sequences: a (100), b (5)" in repr(y) and y.updated() is y
    many = Ranges.from_rows(spark, [("a", k, k, "*") for k in range(1, 30)])
    assert repr(many).count("Row(") == 10 and "start=29" in repr(many)
    dims = spark.createDataFrame([("t", 1), ("z", 2)], "name string, batch int")
    assert ids(x.with_dims(dims)) == [(1, "t"), (7, "z")] and x.with_dims(None).dims is None and x.with_dims(dims).dims is dims
    with pytest.raises(ValueError):
        x.with_dims(dims.drop("name"))
    assert x.table(["name"], F.col("start") < 20).collect()[0][0] == "t"


def test_subsets_of_groups(spark):
    df = spark.createDataFrame([(k, ["c1"] * n, list(range(1, n + 1)), [9] * n, ["+"] * n, n / 2) for k, n in (("A", 2), ("B", 0), ("C", 1), ("D", 3))], "g string, seqnames array<string>, start array<int>, end array<int>, strand array<string>, half double")
    x = RangesList.open(spark, df, "g", seqnames="seqnames", start="start", end="end", strand="strand", mcols=["half"], lengths={"c1": 50})
    names = lambda r: [q["g"] for q in r.df.orderBy(r.place or r.key).collect()]
    assert names(x[[4, 1, 1]]) == ["D", "A", "A"] and names(x[["C", "A"]]) == ["C", "A"] and names(x[1:3]) == ["B", "C"] and names(x[[True, False, True, False]]) == ["A", "C"]
    assert names(x[["C", "A"]].head(1)) == ["C"] and names(x[["C", "A"]].tail(1)) == ["A"] and names(x[["C", "A", "B"]][[2, 3]]) == ["A", "B"] and names(x[[]]) == [] and names(x.take([2, 2])) == ["B", "B"]
    assert names(x[F.col("half") > 0.9]) == ["A", "D"]
    keyed = RangesList.open(spark, df, ["g", ["D", "A"]], seqnames="seqnames", start="start", end="end", strand="strand", dims=spark.createDataFrame([("A",), ("D",), ("Q",)], "g string"))
    assert names(keyed) == ["D", "A"] and keyed.dims is not None
    assert {tuple(r) for r in x.mcols.collect()} == {("A", 1.0), ("B", 0.0), ("C", 0.5), ("D", 1.5)} and x.with_mcols({"z": F.lit(1)}).mcols.columns == ["g", "half", "z"]
    with pytest.raises(ValueError):
        x.with_mcols({"start": F.lit(1)})
    assert x.df.where("g = 'A'").select(x.width).first()[0] == [9, 8] and x.with_seqlengths({"c1": 7}).seqlengths() == {"c1": 7}
    assert repr(x).startswith("RangesList[g") and "sequences: c1 (50)" in repr(x) and x.updated() is x
    assert names(x[["C", "A"]].rename(spark.createDataFrame([("A", "new")], "g string, name string"))) == ["C", "new"]


def test_empty(spark):
    x, y = made(spark, []), made(spark, [("a", 1, 5, "+")])
    for df in (merge.reduce(x), merge.disjoin(x), merge.span(x), merge.intersect(x, y), overlaps.find_overlaps(x, y), overlaps.count_overlaps(x, y), nearest.nearest(x, y), order.order(x), order.rank(x, "min"), tiling.tile(x, n=2), intra.restrict(x, 1, 2), pairwise.distance(x, x), order.duplicated(x)):
        assert df.count() == 0
    assert [tuple(r) for r in overlaps.count_overlaps(y, x).collect()] == [(1, 0)]
    assert [tuple(r) for r in nearest.precede(y, x).collect()] == [(1, None)]
    assert spans(merge.gaps(x, info(spark), ignore_strand=True)) == [("a", 1, 70, "*"), ("b", 1, 40, "*"), ("d", 1, 20, "*")]
    assert not order.is_unsorted(x).first()[0]


def test_empty_subject_through_objects(spark):
    x, none = Ranges.from_rows(spark, [("a", 1, 5, "+"), ("b", 3, 2, "-")]), Ranges.from_rows(spark, [])
    for fn in ("precede", "follow", "nearest"):
        assert sorted(map(tuple, getattr(x, fn)(none).collect())) == [(1, None), (2, None)]
        assert getattr(none, fn)(x).count() == 0
    assert x.distance_to_nearest(none).count() == 0
    assert sorted(map(tuple, x.over(none).collect())) == [(1, False), (2, False)]
    assert x.union(none).df.count() == 2 - 1 and x.setdiff(none).df.count() == 1


def test_null_keys_keep_their_rows(spark):
    """Ranges without a sequence, strand or coordinate: no hits, no neighbours, places as in any order, and a row each."""
    rows = [("a", 1, 9, "+"), (None, 1, 9, "+"), ("a", None, 9, "+"), ("a", 1, 9, None), (None, 1, 9, "+"), ("a", 1, None, "-")]
    x, y = made(spark, rows), made(spark, [("a", 2, 3, "+"), (None, 2, 3, "+"), ("a", 20, 30, "*")])
    for options in ({}, {"minoverlap": 2}, {"kind": "within"}, {"ignore_strand": True}):
        got = dict(map(tuple, overlaps.count_overlaps(x, y, **options).collect()))
        assert got.keys() == set(range(1, 7)) and all(got[k] == 0 for k in (2, 3, 5, 6))
    assert dict(map(tuple, overlaps.count_overlaps(x, y).collect()))[1] == 1
    for fn in (nearest.precede, nearest.follow, nearest.nearest):
        got = dict(map(tuple, fn(x, y).collect()))
        assert got.keys() == set(range(1, 7)) and got[2] is got[5] is None
    ranks = lambda t: [r[1] for r in order.rank(x, t).orderBy("rid").collect()]
    assert ranks("min") == [5, 1, 4, 3, 1, 6] and ranks("dense") == [4, 1, 3, 2, 1, 5] and ranks("first") == [5, 1, 4, 3, 2, 6]


def test_coordinates_at_the_end(spark):
    top = 2**31 - 1
    x = made(spark, [("a", top - 4, top, "+"), ("a", -top, top, "*"), ("a", top, top, "-"), ("a", -top - 1, -top, "+")])
    assert dict(map(tuple, overlaps.count_overlaps(x, x).collect())) == {1: 2, 2: 4, 3: 2, 4: 2}
    assert dict(map(tuple, overlaps.count_overlaps(x, x, maxgap=5).collect())) == {1: 2, 2: 4, 3: 2, 4: 2}
    assert overlaps.find_overlaps(x, x, maxgap=3).count() == 10 and overlaps.find_overlaps(x, x, kind="equal", maxgap=1).count() == 4
    assert {tuple(r) for r in nearest.distance_to_nearest(x.where("rid in (1, 3)"), x.where("rid = 4"), ignore_strand=True).collect()} == {(1, 4, 2 * top - 5), (3, 4, 2 * top - 1)}
    assert spans(merge.reduce(x.where("rid in (1, 4)"))) == [("a", -top - 1, -top, "+"), ("a", top - 4, top, "+")]
    assert merge.disjoin(x).count() == 4 and merge.coverage(x, info(spark, {"a": None})).where("depth = 3").count() == 1


def test_a_deep_place_is_no_task_of_its_own(spark):
    """Half of the queries ask at one place: no window and no group of theirs is in the plan, only joins to the rows of bins."""
    rows = [("a", 100, 110, "+")] * 400 + [("a", 7 * k, 7 * k + 3, "-") for k in range(1, 400)]
    x, y = made(spark, rows), made(spark, [("a", 9 * k, 9 * k + 5, "*") for k in range(1, 300)])
    want = brute.overlap_pairs(rows, [("a", 9 * k, 9 * k + 5, "*") for k in range(1, 300)])
    got = overlaps.count_overlaps(x, y, width=64)
    counts = [0] * len(rows)
    for i, _ in want:
        counts[i - 1] += 1
    assert [r[1] for r in got.orderBy("query_idx").collect()] == counts
    for df in (got, overlaps.count_overlaps(x, y, minoverlap=4), nearest.precede(x, y, width=64)):
        text = plan_text(df)
        assert no_pair_enumeration(df)
        for window in (line for line in text.split("\n") if " Window " in line or line.lstrip("+- :").startswith("Window")):
            assert "query_idx" not in window and "rid" not in window.split("[")[0]


def test_counts_of_long_overlaps(spark):
    q, s = both(31)
    x, y = made(spark, q), made(spark, s)
    for m in (2, 3, 6):
        for ignore in (False, True):
            want = [0] * len(q)
            for i, _ in brute.overlap_pairs(q, s, -1, m, ignore):
                want[i - 1] += 1
            df = overlaps.count_overlaps(x, y, minoverlap=m, ignore_strand=ignore, width=16)
            assert [r[1] for r in df.orderBy("query_idx").collect()] == want


def test_counts_of_containing_ranges(spark):
    q, s = both(35)
    x, y = made(spark, q), made(spark, s)
    for m in (0, 3):
        for ignore in (False, True):
            want = {i: sum(a[0] == b[0] and (ignore or brute.meets(a[3], b[3])) and b[1] <= a[1] and a[2] <= b[2] and a[2] - a[1] + 1 >= m for b in s) for i, a in enumerate(q, 1)}
            df = overlaps.count_overlaps(x, y, kind="within", minoverlap=m, ignore_strand=ignore, width=16)
            assert dict(map(tuple, df.collect())) == want
    text = plan_text(df)
    assert no_pair_enumeration(df) and "subject_idx" not in text and "__level" not in text
    far = made(spark, [("a", -(2**31), 2**31 - 1, "+"), ("a", 2**31 - 1, 2**31 - 1, "+"), (None, 1, 2, "+")])
    assert dict(map(tuple, overlaps.count_overlaps(far, far, kind="within").collect())) == {1: 1, 2: 2, 3: 0}


def test_a_pile_of_equal_ranges_is_paired_once(spark):
    """Five thousand equal queries on five thousand equal subjects, with others: no query meets more than the distinct subjects."""
    pile = lambda n, at: spark.range(1, n + 1).select(F.col("id").alias("rid"), F.lit("a").alias("seqnames"), F.lit(at).alias("start"), F.lit(at + 9).alias("end"), F.lit("+").alias("strand"))
    x = pile(5000, 100).unionByName(made(spark, [("a", 500, 510, "-")]).withColumn("rid", F.lit(9999).cast("long")))
    y = pile(5000, 105).unionByName(made(spark, [("a", 495, 501, "*")]).withColumn("rid", F.lit(7).cast("long")))
    first, last = (overlaps.find_overlaps(x, y, select=k).groupBy("subject_idx").count().collect() for k in ("first", "last"))
    assert {tuple(r) for r in first} == {(1, 5000), (7, 1)} and {tuple(r) for r in last} == {(5000, 5000), (7, 1)}
    assert {tuple(r) for r in nearest.distance_to_nearest(x, y).groupBy("subject_idx", "distance").count().collect()} == {(1, 0, 5000), (7, 0, 1)}


def test_one_hit_by_blocks(spark):
    q, s = both(5)
    s[0], q[0] = ("a", 1, 5000, "*"), ("b", -70, 9000, "+")
    x, y = made(spark, q), made(spark, s)
    cases = [({}, False, False), ({"maxgap": 0}, True, True), ({"maxgap": 4}, False, True), ({"minoverlap": 3}, True, False), ({"minoverlap": 2, "maxgap": 3, "ignore_strand": True}, False, False), ({"maxgap": 0, "ignore_strand": True}, False, True)]
    for options, last, own in cases:
        want = brute.overlap_pairs(q, q if own else s, options.get("maxgap", -1), options.get("minoverlap", 0), options.get("ignore_strand", False))
        best = {a: (max if last else min)(b for c, b in want if c == a and not (own and b == a)) for a in {a for a, b in want if not (own and a == b)}}
        got = [tuple(r) for r in overlaps.one_hit(x, x if own else y, last, own=own, blocks=True, **options).collect()]
        assert len(got) == len(best) and dict(got) == best, (options, last, own)


def test_counts_and_one_hit_by_edges(spark):
    """Counts of edges and of overlaps with a gap and a least overlap, against the pairs, from plans that do not pair."""
    q, s = both(3)
    x, y = made(spark, q), made(spark, s * 2)
    for options in ({"kind": "start"}, {"kind": "end", "maxgap": 2}, {"kind": "equal"}, {"kind": "start", "ignore_strand": True}, {"maxgap": 2, "minoverlap": 3}):
        pairs = [tuple(r) for r in overlaps.overlap_pairs(x, y, **options).collect()]
        counts = [tuple(r) for r in overlaps.count_overlaps(x, y, width=16, **options).collect()]
        assert sorted(counts) == [(i, sum(a == i for a, _ in pairs)) for i in range(1, len(q) + 1)], options
        got = {r[0]: r[1] for r in overlaps.find_overlaps(x, y, select="last", **options).collect()}
        assert got == {i: max((b for a, b in pairs if a == i), default=None) for i in range(1, len(q) + 1)}, options


def test_a_pile_of_distinct_ranges_is_not_paired(spark):
    """Five thousand distinct queries that all overlap as many distinct subjects."""
    n = 5000
    pile = lambda up: spark.range(1, n + 1).select(F.col("id").alias("rid"), F.lit("a").alias("seqnames"), (n - F.col("id") if up else F.col("id")).alias("start"), (2 * n + (F.col("id") if up else -F.col("id"))).alias("end"), F.lit("+").alias("strand"))
    x, y = pile(True), pile(False)
    assert overlaps.piled(x, y, overlaps.bin_plan(x, y), -1)
    for select, place in (("first", 1), ("last", n)):
        got = overlaps.find_overlaps(x, y, select=select)
        assert [tuple(r) for r in got.groupBy("subject_idx").count().collect()] == [(place, n)]
    assert {tuple(r) for r in nearest.distance_to_nearest(x).groupBy("subject_idx", "distance").count().collect()} == {(1, 0, n - 1), (2, 0, 1)}


def test_edges_meet_on_their_coordinates(spark):
    q, s = both(32)
    x, y = made(spark, q), made(spark, s)
    rule = {"start": lambda a, b, off: abs(a[1] - b[1]) <= off, "end": lambda a, b, off: abs(a[2] - b[2]) <= off, "equal": lambda a, b, off: abs(a[1] - b[1]) <= off and abs(a[2] - b[2]) <= off}
    for kind, holds in rule.items():
        for gap in (-1, 0, 1, 4):
            df = overlaps.find_overlaps(x, y, kind=kind, maxgap=gap)
            want = {(i, j) for i, a in enumerate(q, 1) for j, b in enumerate(s, 1) if a[0] == b[0] and brute.meets(a[3], b[3]) and holds(a, b, max(gap, 0))}
            found = [tuple(r) for r in df.collect()]
            assert len(found) == len(set(found)) and set(found) == want
        assert "__bin" not in plan_text(df) and f"__{'s' if kind != 'end' else 'e'}" in plan_text(df)


def test_links(spark):
    q, _ = both(33)
    x = made(spark, q)
    for gap in (1, 3):
        for ignore in (False, True):
            got = merge.reduce_links(x, gap, ignore, width=16).collect()
            assert sorted(r["member"] for r in got) == list(range(1, len(q) + 1))
            made_ = {(r["seqnames"], r["start"], r["end"], r["strand"]) for r in got}
            assert made_ == set(brute.reduced(q, gap, ignore))
            for r in got:
                n, a, b, t = q[r["member"] - 1]
                assert n == r["seqnames"] and r["strand"] == ("*" if ignore else t) and r["start"] <= a and b <= r["end"]
    got = {(r["seqnames"], r["start"], r["end"], r["strand"], r["member"]) for r in merge.disjoin_links(x).collect()}
    parts = {tuple(r) for r in merge.disjoin(x).select("seqnames", "start", "end", "strand").collect()}
    assert got == {(*p, k) for p in parts for k, (n, a, b, t) in enumerate(q, 1) if (n, t) == (p[0], p[3]) and a <= p[1] and p[2] <= b}
    with pytest.raises(ValueError):
        merge.reduce_links(x, 0)


def test_places_are_written_down(spark):
    """Nothing is kept on executors: the sorted table lies in the shared folder, and places stay the same when it is read again."""
    from spanforge.plans.storage import own_dir, release

    x = with_ordinal(spark.range(1000).select((F.col("id") % 7).alias("k"), "id"), [F.col("k"), F.col("id").desc()], "place")
    once = sorted(map(tuple, x.collect()))
    assert [r[0] for r in sorted(once, key=lambda r: r[2])] == sorted(r[0] for r in once) and sorted(r[2] for r in once) == list(range(1, 1001))
    assert "InMemoryTableScan" not in plan_text(x) and own_dir(spark).split("/")[-1] in x.inputFiles()[0]
    spark.catalog.clearCache()
    assert sorted(map(tuple, x.collect())) == once
    release(spark)
    assert with_ordinal(spark.range(0).toDF("id"), [F.col("id")], "place").collect() == []


def test_level_order(spark):
    x = Ranges.from_rows(spark, [("chr10", 5, 6, "+"), ("chr2", 1, 2, "-"), ("chrX", 1, 1, "*"), ("chr2", 1, 1, "-"), ("chrM", 2, 2, "*")])
    names = lambda r: [q["seqnames"] for q in r.df.orderBy("rid").collect()]
    assert names(x.sort()) == ["chr10", "chr2", "chr2", "chrM", "chrX"]
    assert names(x.sort(level_order=["chr2", "chr10", "chrX"])) == ["chr2", "chr2", "chr10", "chrX", "chrM"]
    assert [r["rid"] for r in x.order(level_order=["chr2", "chr10"]).orderBy("pos").collect()] == [4, 2, 1, 5, 3]
    assert [r["rank"] for r in x.rank(level_order=["chrX"], ties="dense").orderBy("rid").collect()] == [2, 4, 1, 3, 5]
    assert x.sort(level_order=["chr2"]).is_unsorted() and not x.sort(level_order=["chr2"]).is_unsorted(level_order=["chr2"])


def test_shift_by_sequence(spark):
    x = made(spark, [("a", 5, 9, "+"), ("b", 5, 9, "-"), ("b", 1, 2, "-")])
    runs = lambda df: sorted((r["seqnames"], r["start"], r["end"], r["depth"]) for r in df.where("depth > 0").collect())
    assert runs(merge.coverage(x, info(spark), shift={"b": -6})) == [("a", 5, 9, 1), ("b", 1, 3, 1)]
    assert runs(merge.coverage(x, info(spark), shift={"a": 2**31}, weight=np.int64(2))) == [("b", 1, 2, 2), ("b", 5, 9, 2)]


def test_stored_for_joins(spark, tmp_path):
    """The stored side is read where it lies: no exchange above it, folders pruned by sequence, the same pairs."""
    q, s = both(34)
    s[0] = ("a", 1, 90_000, "*")
    x, y = made(spark, q), made(spark, s)
    overlaps.store(y, "stored_test", str(tmp_path / "t"), 5)
    try:
        for options in ({}, {"maxgap": 4}, {"minoverlap": 3}, {"kind": "within"}, {"ignore_strand": True}):
            got = [tuple(r) for r in overlaps.stored_pairs(x, "stored_test", **options).collect()]
            assert len(got) == len(set(got)) and set(got) == {tuple(r) for r in overlaps.overlap_pairs(x, y, **options).collect()}
        assert sorted(map(tuple, overlaps.stored(spark, "stored_test").select("rid", "start").collect())) == sorted((k, r[1]) for k, r in enumerate(s, 1))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = overlaps.stored_pairs(x, "stored_test", sequences=["a"])
        text = plan_text(df)
        below = text.split("SortMergeJoin")[1]
        scan = next(part for part in below.split("Exchange")[::-1] if "stored_test" in part or "sequence" in part)
        assert "Bucketed: true" in text and text.count("Exchange hashpartitioning") == 1 and "PartitionFilters" in scan and "sequence" in scan
        assert {r[0] for r in df.collect()} == {i for i, j in brute.overlap_pairs(q, s) if q[i - 1][0] == "a"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE stored_test")


def test_properties(spark):
    q, s = both(77)
    x, y = made(spark, q), made(spark, s)
    once = merge.reduce(x, drop_empty=True)
    assert spans(merge.reduce(once)) == spans(once)
    assert spans(merge.reduce(merge.disjoin(x))) == spans(once)
    assert merge.intersect(merge.setdiff(x, y), y).count() == 0
    runs = merge.coverage(x, info(spark, dict.fromkeys("abc")))
    assert runs.agg(F.sum(F.col("width") * F.col("depth"))).first()[0] == sum(e - b + 1 for _, b, e, _ in q)


def test_plans(spark, tmp_path):
    q, s = both(5)
    made(spark, q).write.parquet(str(tmp_path / "q"))
    x, y = spark.read.parquet(str(tmp_path / "q")), made(spark, s)
    for df in (overlaps.find_overlaps(x, y), overlaps.count_overlaps(x, y), nearest.nearest(x, y), merge.coverage(x, info(spark)), merge.intersect(x, y), merge.reduce(x)):
        assert no_pair_enumeration(df) and stays_in_jvm(df)
    a, b = (spark.read.parquet(str(tmp_path / "q")).where(f"rid <> {k}") for k in (998, 999))
    for df, inputs in ((merge.setdiff(a, b), 2), (merge.reduce(a), 1), (nearest.precede(a, b), 2), (merge.union(a, b), 2)):
        df.collect()
        assert plan_text(df).split("== Initial Plan ==")[0].count("Scan parquet") <= 2 * inputs
    text = pushed_filters(intra.restrict(x, 10, 50))
    assert "GreaterThanOrEqual(end,10)" in text and "LessThanOrEqual(start,50)" in text


def shuffle_files(spark) -> dict[str, int]:
    """The shuffle files that lie on this machine's disk now, with their bytes."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName(): f.length() for f in map(files.apply, range(files.size())) if f.getName().startswith("shuffle_")}


def left_behind(spark, fn) -> int:
    """Bytes of shuffle files that ``fn`` leaves."""
    before = shuffle_files(spark)
    fn()
    return sum(n for name, n in shuffle_files(spark).items() if name not in before)


def scattered(seed, n, most):
    """Ranges of up to ``most`` bases over 15 bases a range."""
    rng = random.Random(seed)
    return [(rng.choice("abc"), s, s + rng.randrange(-1, most), rng.choice("+-*")) for s in (rng.randrange(1, 15 * n) for _ in range(n))]


def test_counts_of_containing_ranges_on_disk(spark):
    """A range is not moved once for every bit of a coordinate, and what a step moved goes with it."""
    q, s = scattered(1, 4000, 50), scattered(2, 4000, 400)
    x, y = made(spark, q).repartition(4), made(spark, s).repartition(4)
    got = {}
    moved = left_behind(spark, lambda: got.update(map(tuple, overlaps.count_overlaps(x, y, kind="within", minoverlap=2).collect())))
    assert moved < 60 * (len(q) + len(s))
    places = defaultdict(list)
    for b in s:
        places[b[0]].append(b)
    for i, a in list(enumerate(q, 1))[:300]:
        assert got[i] == sum(brute.meets(a[3], b[3]) and b[1] <= a[1] and a[2] <= b[2] and a[2] - a[1] + 1 >= 2 for b in places[a[0]])
    # Piles: wide queries, with many ranges inside and around them.
    q, s = [("a", 1 + k % 7, 400 + k % 90, "+-*"[k % 3]) for k in range(200)], [("a", k % 50, k % 50 + 7 * (k % 70) - 1, "+-*"[k % 3]) for k in range(900)]
    for width in (64, 1 << 16):
        got = dict(map(tuple, overlaps.count_overlaps(made(spark, q), made(spark, s), kind="within", width=width).collect()))
        assert got == {i: sum(brute.meets(a[3], b[3]) and b[1] <= a[1] and a[2] <= b[2] for b in s) for i, a in enumerate(q, 1)}


def test_all_neighbours_on_disk(spark):
    """An x is moved once to be looked up, then either for its pairs or for its coordinates; what a step moved goes with it."""
    q, s = scattered(3, 6000, 50), scattered(4, 3000, 400)
    x, y = made(spark, q).repartition(4), made(spark, s).repartition(4)
    got = defaultdict(list)
    moved = left_behind(spark, lambda: [got[r[0]].append((r[1], r[2])) for r in nearest.distance_to_nearest(x, y, "all").collect()])
    assert moved < 40 * (len(q) + len(s))
    for i in range(1, 201):
        d, js = brute.nearest([q[i - 1]], s)[1]
        assert sorted(got[i]) == [(j, d) for j in js]


@pytest.mark.parametrize("seed", ROUNDS)
def test_all_neighbours(spark, seed):
    q, s = both(80 + seed)
    s[0], q[0], q[1] = ("a", 1, 5000, "*"), ("b", -90, -80, "-"), ("c", 3000, 3999, "+")
    x, y = made(spark, q), made(spark, s)
    for ignore in (False, True):
        for subject, want in ((y, brute.nearest(q, s, ignore)), (None, brute.nearest(q, q, ignore, own=True))):
            for width in (16, 1 << 16):
                df = nearest.distance_to_nearest(x, subject, "all", ignore, width=width)
                assert sorted(map(tuple, df.collect())) == sorted((i, j, d) for i, (d, js) in want.items() for j in js)
    assert no_pair_enumeration(df) and stays_in_jvm(df)
