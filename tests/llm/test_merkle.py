"""Merkle manifest against a plain tree, odd rows, sizes around families and blocks."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from spanforge.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, id string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(rows):
    """(id, leaf, subroot, root, proof, folded, verified) of rows of the five fields."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    sources: dict = {}
    for row in rows:
        leaf = digest(*map(field, row))
        bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
        sources.setdefault(row[1], []).append(((row[0] is not None, row[0] or 0, leaf), digest(*map(field, (*row[:4], low(row[4])))) if bad else leaf, row[0]))

    def tree(level):
        out = [level]
        while len(out[-1]) > 1:
            out.append([digest(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
        return out

    def path(levels, at):
        steps = []
        for level in levels[:-1]:
            first = at - at % 16
            steps.append((level[first:at], level[at + 1 : first + 16]))
            at //= 16
        return steps

    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for rows in sources.values():
        rows.sort(key=lambda e: e[0])
    trees = {s: tree([e[0][2] for e in sources[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for k, ((_, _, leaf), changed, i) in enumerate(sources[s]):
            steps, h = path(trees[s], k) + path(top, j), changed
            for a, b in steps:
                h = digest(*a, h, *b)
            out.append((i, leaf, trees[s][-1][0], top[-1][0], digest(*(x for a, b in steps for x in a + b)), h, h == top[-1][0]))
    return sorted(out, key=repr)


def made(spark, rows, block):
    df = spark.createDataFrame([(*x, "clash", "clash") for x in rows], SCHEMA).repartition(5)
    suspect = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = merkle.manifest(df, tampered={"text": merkle.lowered(F.col("text"))}, suspect=suspect, block=block)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, out.collect()), key=repr)


def rows_of(n, sources):
    return [(7 * k, f"s{k % sources}" if k % 11 else None, "en" if k % 3 else None, k, f"Text {k} É" if k % 5 else None) for k in range(n)]


@pytest.mark.parametrize(("n", "sources", "block"), [(1, 1, 4096), (2, 2, 1), (17, 1, 5), (600, 2, 37), (600, 40, 100)])
def test_against_plain(spark, n, sources, block):
    assert made(spark, rows_of(n, sources), block) == plain(rows_of(n, sources))


def test_odd_rows(spark):
    rows = [*rows_of(50, 3), *rows_of(20, 3), (None, None, None, None, None), (None, None, None, None, None), (None, "", "", 0, ""), (5, "ü", "en", 1, "A" * 300_000), (-3, "Z", "en", 1, "ABC"), (-3, "Z", "en", 1, "XYZ")]
    got = made(spark, rows, 16)
    assert got == plain(rows)
    assert any(not x[-1] for x in got)


def test_empty(spark):
    assert made(spark, [], 4096) == []


def test_an_untampered_manifest_verifies(spark):
    df = spark.createDataFrame([(*x, None, None) for x in rows_of(100, 3)], SCHEMA)
    assert merkle.manifest(df).where("not verified").count() == 0


def test_a_block_lacks_the_least(spark):
    """Nodes fetched for a stretch of leaves are those of its families that it does not have, and no more."""
    n, lo, hi = 5000, 130, 977
    got = {(r["level"], r["idx"]) for r in merkle.lacking(spark.createDataFrame([(0, 0, n, lo, hi)], "block long, tree long, n long, lo long, hi long"), n).collect()}
    want, level, own = set(), 0, set(range(lo, hi + 1))
    while n > 1:
        want |= {(level, k) for p in {k // 16 for k in own} for k in range(16 * p, min(16 * p + 16, n)) if k not in own}
        own, n, level = {k // 16 for k in own}, (n - 1) // 16 + 1, level + 1
    assert got == want
