"""Merkle manifest of a table: a tree of leaves per source, a tree of the sources' roots, proofs by octopus multiproof.

A leaf is the hash of a row's fields. Leaves of a source stand in the order of ids; every sixteen nodes have a parent until
one node is left. The leaves are cut into blocks of as many. A block's leaves are one stretch of places in each of its
sources, so at each level the nodes that it lacks for the proofs of all of its leaves are those at both ends of the
stretch that complete its outermost families: fifteen on each side at most, their minimal union. They are named by coordinate (tree,
level, place), fetched by one join for all blocks, and inside a block everything else follows: shared inner nodes
are derived once, and each leaf's own proof is read off them.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import drop_saved, numbered, saved

#: Children of a node; leaves of a block.
FAN, BLOCK = 16, 4096
#: The tree over the sources.
TOP = -1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """``-`` for null, else the number of bytes of its text in UTF-8, a colon and the text."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def tower(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """All levels above ``nodes`` (tree, n, idx, h), each saved, and (tree, h) of every tree's last node.

    ``n`` is the number of nodes of the tree at that level, ``most`` the largest. A family is one group of sixteen rows at most,
    so no tree is large for a task.
    """
    levels, tops, now = [], [nodes.where("n = 1").select("tree", "h")], nodes
    while most > 1:
        family = F.sort_array(F.collect_list(F.struct("idx", "h")))
        above = now.where("n > 1").groupBy("tree", "n", F.shiftright("idx", 4).alias("idx")).agg(family.alias("f"))
        now = saved(above.select("tree", (F.shiftright(F.col("n") - 1, 4) + 1).alias("n"), "idx", F.sha2(F.array_join(F.transform("f", lambda x: x["h"]), ""), 256).alias("h")))
        levels.append(now)
        tops.append(now.where("n = 1").select("tree", "h"))
        most = (most - 1) // FAN + 1
    every = tops[0]
    for t in tops[1:]:
        every = every.unionByName(t)
    return levels, every


def height(n: int) -> int:
    out = 0
    while n > 1:
        n, out = (n - 1) // FAN + 1, out + 1
    return out


def lacking(stretches: DataFrame, most: int) -> DataFrame:
    """(block, tree, level, idx) that a block lacks whose leaves are the places lo to hi of a tree of n leaves, for (block, tree, n, lo, hi)."""
    if height(most) == 0:
        return stretches.select("block", "tree", F.lit(0).alias("level"), F.col("lo").alias("idx")).where("false")
    levels = stretches.select("*", F.explode(F.sequence(F.lit(0), F.lit(height(most) - 1))).alias("level"))
    at = levels.select("block", "tree", "level", F.expr("shiftright(n - 1, 4 * level) + 1").alias("n"), F.expr("shiftright(lo, 4 * level)").alias("lo"), F.expr("shiftright(hi, 4 * level)").alias("hi")).where("n > 1")
    first, last = F.expr("shiftleft(shiftright(lo, 4), 4)"), F.least(F.col("n") - 1, F.expr("shiftleft(shiftright(hi, 4), 4) + 15"))
    none = F.array().cast("array<bigint>")
    left = F.when(first < F.col("lo"), F.sequence(first, F.col("lo") - 1)).otherwise(none)
    right = F.when(last > F.col("hi"), F.sequence(F.col("hi") + 1, last)).otherwise(none)
    return at.select("block", "tree", "level", F.explode(F.concat(left, right)).alias("idx"))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Octopus:
    """The nodes that one block knows: its leaves, what it has fetched, and what follows from both."""

    def __init__(self, leaves: dict[tuple[int, int], str], sizes: dict[int, int], fetched: dict[tuple[int, int, int], str], n_trees: int):
        self.sizes = {**sizes, TOP: n_trees}
        self.known = {(tree, 0, at): h for (tree, at), h in leaves.items()} | fetched
        self.above: dict[tuple[int, int, int], tuple[str, list[tuple[str, str]]]] = {}
        own: dict[int, set[int]] = {}
        for tree, at in leaves:
            own.setdefault(tree, set()).add(at)
        self.subroots = {tree: self.grow(tree, ats) for tree, ats in own.items()}
        self.known |= {(TOP, 0, tree): h for tree, h in self.subroots.items()}
        self.root = self.grow(TOP, set(own))

    def count(self, tree: int, level: int) -> int:
        return ((self.sizes[tree] - 1) >> (4 * level)) + 1

    def family(self, tree: int, level: int, at: int) -> tuple[str, str]:
        """What stands left and right of a node in its family."""
        first = at - at % FAN
        row = [self.known[tree, level, k] for k in range(first, min(first + FAN, self.count(tree, level)))]
        return "".join(row[: at - first]), "".join(row[at - first + 1 :])

    def grow(self, tree: int, ats: set[int]) -> str:
        """Derives the nodes above some places level by level; the last one is returned."""
        level = 0
        while self.count(tree, level) > 1:
            ats = {k // FAN for k in ats}
            for k in ats:
                left, right = self.family(tree, level, FAN * k)
                self.known[tree, level + 1, k] = sha(left + self.known[tree, level, FAN * k] + right)
            level += 1
        return self.known[tree, level, 0]

    def path(self, tree: int, level: int, at: int) -> tuple[str, list[tuple[str, str]]]:
        """The joined siblings from a node to the root, and the siblings left and right of each step; shared by all leaves below an inner node."""
        if (tree, level, at) in self.above:
            return self.above[tree, level, at]
        if self.count(tree, level) == 1:
            out = ("", []) if tree == TOP else self.path(TOP, 0, tree)
        else:
            left, right = self.family(tree, level, at)
            text, steps = self.path(tree, level + 1, at // FAN)
            out = left + right + text, [(left, right), *steps]
        if level or tree == TOP:
            self.above[tree, level, at] = out
        return out

    def fold(self, h: str, steps: list[tuple[str, str]]) -> str:
        for left, right in steps:
            h = sha(left + h + right)
        return h


def manifest(docs: DataFrame, *, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", source_col: str = "source", tampered: dict[str, Column] | None = None, suspect: Column | None = None, block: int = BLOCK) -> DataFrame:
    """One row per input row: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tampered`` replaces columns in the rows where ``suspect`` holds, after the manifest was made: their path is folded from the changed leaf
    with the siblings of the manifest. Null fields are leaves' ``-``; a null source is the first source, a null id the first id of its source; empty and very
    long texts are hashed whole; rows with one id stand in the order of their leaves, and identical rows are leaves of their own, side by side;
    other columns are ignored. A lone leaf is its subroot and a lone subroot the root. An empty table gives an empty result.
    """
    old = leaf([F.col(f"`{c}`") for c in columns])
    new = leaf([(tampered or {}).get(c, F.col(f"`{c}`")) for c in columns])
    changed = F.when(F.coalesce(suspect, F.lit(False)), new) if suspect is not None else F.lit(None).cast("string")
    hashed = saved(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), old.alias("leaf"), changed.alias("changed")))
    placed = numbered(hashed, [F.col(c) for c in ("source", "id", "leaf")], "g")
    # The first place of a source names it: places are in the order of sources.
    sources = placed.groupBy("source").agg(F.count("*").alias("n"), F.min("g").alias("first"))
    trees = numbered(sources, [F.col("first")], "tree")
    size = trees.agg(F.count("*"), F.max("n")).first()
    n_trees, most = size[0], size[1] or 0
    cut = placed.withColumn("block", F.floor(F.col("g") / block))
    per = cut.groupBy("block", "source").agg(F.min("g").alias("lo"), F.max("g").alias("hi"))
    a, b = per.alias("a"), trees.alias("b")
    held = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.block", "a.source", "b.tree", "b.n", (F.col("a.lo") - F.col("b.first")).alias("lo"), (F.col("a.hi") - F.col("b.first")).alias("hi"), "b.first")
    held = saved(held)
    a, b = cut.alias("a"), held.alias("b")
    leaves = saved(a.join(b, (F.col("a.block") == F.col("b.block")) & F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.block", "b.tree", "b.n", (F.col("a.g") - F.col("b.first")).alias("idx"), "a.id", F.col("a.leaf").alias("h"), "a.changed"))
    drop_saved(hashed, placed, trees)
    base = leaves.select("tree", "n", "idx", "h")
    levels, subroots = tower(base, most)
    subroots = saved(subroots)
    top = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"), F.col("tree").alias("idx"), "h")
    top_levels, _ = tower(top, n_trees)
    nodes = base.select("tree", F.lit(0).alias("level"), "idx", "h")
    for k, x in [(0, top), *enumerate(top_levels, 1), *enumerate(levels, 1)]:
        nodes = nodes.unionByName(x.select("tree", F.lit(k).alias("level"), "idx", "h"))
    own = held.groupBy("block").agg(F.min("tree").alias("lo"), F.max("tree").alias("hi")).select("block", F.lit(TOP).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"), "lo", "hi")
    wanted = lacking(held.select("block", "tree", "n", "lo", "hi"), most).unionByName(lacking(own, n_trees))
    fetched = saved(wanted.join(nodes, ["tree", "level", "idx"]).select("block", "tree", "level", "idx", "h"))
    drop_saved(held, subroots, *levels, *top_levels)

    def expand(mine: pa.Table, others: pa.Table) -> pa.Table:
        row = {c: mine.column(c).to_pylist() for c in ("tree", "n", "idx", "h", "changed")}
        where = list(zip(row["tree"], row["idx"], strict=True))
        far = dict(zip(zip(*(others.column(c).to_pylist() for c in ("tree", "level", "idx")), strict=True), others.column("h").to_pylist(), strict=True))
        known = Octopus(dict(zip(where, row["h"], strict=True)), dict(zip(row["tree"], row["n"], strict=True)), far, n_trees)
        proofs, folded = [], []
        for (tree, at), h, other in zip(where, row["h"], row["changed"], strict=True):
            text, steps = known.path(tree, 0, at)
            proofs.append(sha(text))
            folded.append(known.fold(h if other is None else other, steps))
        n = mine.num_rows
        return pa.table({"id": mine.column("id"), "leaf": mine.column("h"), "subroot": pa.array([known.subroots[t] for t in row["tree"]], pa.string()), "root": pa.array([known.root] * n, pa.string()), "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([x == known.root for x in folded], pa.bool_())})

    kind = leaves.schema["id"].dataType.simpleString()
    out = leaves.groupBy("block").cogroup(fetched.groupBy("block")).applyInArrow(expand, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumnRenamed("id", id_col)
