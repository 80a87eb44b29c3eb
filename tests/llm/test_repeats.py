"""Repeats: transform and prefixes against sorted suffixes, removal against all windows, odd rows."""

import hashlib
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from spanforge.llm import repeats as r

SCHEMA = "doc_id long, text string, id string, piece string"


def strings(rng, n, most, alphabet):
    return [bytes(rng.integers(97, 97 + alphabet, rng.integers(1, most)).astype(np.uint8)) for _ in range(n)]


def test_transform_is_that_of_sorted_suffixes():
    rng = np.random.default_rng(0)
    for t in range(40):
        s = strings(rng, rng.integers(1, 9), 30, rng.integers(1, 4))
        s += s[:2] if t % 3 == 0 else []
        suffixes = sorted(((x[k:], i, k) for i, x in enumerate(s) for k in range(len(x) + 1)), key=lambda e: ([c + 1 for c in e[0]] + [0], e[1]))
        bwt, prefix, order = r.transform(*r.joined(s))
        assert bwt.tolist() == [s[i][k - 1] + 1 if k else 0 for _, i, k in suffixes]
        common = [0] + [next((q for q, (a, b) in enumerate(zip(x[0], y[0], strict=False)) if a != b), min(len(x[0]), len(y[0]))) for x, y in zip(suffixes, suffixes[1:], strict=False)]
        assert prefix.tolist() == common
        assert order.tolist() == sorted(range(len(bwt)), key=lambda k: (bwt[k], k))[len(s) :]


def test_range_minima():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 99, 3000).astype(np.uint8)
    a = rng.integers(0, 3000, 500)
    z = np.minimum(a + rng.integers(0, 2999, 500), 2999)
    assert r.Minima(x).of(a, z).tolist() == [x[i : j + 1].min() for i, j in zip(a, z, strict=True)]


def test_pieces_hold_every_window_once_and_equal_windows_meet():
    rng = np.random.default_rng(2)
    texts = [b"", b"a" * 300, b"ab" * 200, b"x" * 49, b"y" * 50, *strings(rng, 20, 400, 2), bytes(rng.integers(0, 256, 500).astype(np.uint8))]
    data, ends = r.joined(texts)
    for seed in (0, 1):
        seen: dict[bytes, set[int]] = {}
        at = []
        for place, size, anchor in zip(*r.pieces(data, ends, seed), strict=True):
            assert 1 <= size <= r.SPREAD
            for k in range(place, place + size):
                at.append(k)
                seen.setdefault(data[k : k + 50].tobytes(), set()).add(int(anchor))
        starts = np.concatenate([[0], ends[:-1]])
        assert at == [s + k for s, x in zip(starts, texts, strict=True) for k in range(len(x) - 49)]
        assert all(len(v) == 1 for v in seen.values())


def plain(rows):
    """(id, bytes, removed, spans, digest) of each row, from all windows."""
    low: dict[bytes, int] = {}
    for i, b in rows:
        for k in range(len(b) - 49):
            low[b[k : k + 50]] = min(low.get(b[k : k + 50], 1 << 62), 1 << 61 if i is None else i)
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if low[b[k : k + 50]] < (1 << 61 if i is None else i):
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def removed(df):
    rows = r.remove(df).collect()
    for x in rows:
        assert x["n_removed"] == sum(z - a for a, z in zip(x["spans"][::2], x["spans"][1::2], strict=True)) and x["n_spans"] * 2 == len(x["spans"])
    return sorted(((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], hashlib.sha256(x["kept"]).hexdigest()) for x in rows), key=repr)


def corpus():
    rng = np.random.default_rng(4)
    word = lambda: "".join(chr(c) for c in rng.integers(97, 123, rng.integers(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, long, family = text(20), text(4000), text(80)
    docs = [(k, f"{text(30)} {shared} {text(5)}") for k in range(100, 140)]
    docs += [(k, family.replace(" ", f" {word()} ", 1) if k % 3 else family) for k in range(40)]
    docs += [(50, long), (51, long[5000:15000]), (52, f"é{shared}ü{shared}"), (53, ""), (54, None), (55, "z" * 500), (56, "z" * 80), (57, "q" * 49), (58, "q" * 49)]
    docs += [(60, family), (60, family), (60, text(9) + family), (None, family), (None, shared), (None, None)]
    return docs


def test_against_all_windows(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], SCHEMA).repartition(7)
    assert removed(df) == plain([(i, (t or "").encode()) for i, t in docs])


def test_crowded_anchors_are_cut_again(spark, monkeypatch):
    """A passage of sixteen bytes in many surroundings: its pieces outgrow a collection and are cut by other anchors."""
    rng = np.random.default_rng(5)
    noise = lambda n: "".join(chr(c) for c in rng.integers(97, 123, n))
    docs = [(k, noise(60) + "the same passage" + noise(60)) for k in range(60)]
    docs += [(100 + k, docs[k][1][20:100] + noise(30)) for k in range(0, 60, 7)]
    monkeypatch.setattr(r, "LIMIT", 700)
    df = spark.createDataFrame([(i, t, None, None) for i, t in docs], SCHEMA)
    assert removed(df) == plain([(i, t.encode()) for i, t in docs])


def test_a_long_text_is_cut_in_segments(monkeypatch):
    rng = np.random.default_rng(6)
    data, ends = r.joined(strings(rng, 5, 900, 3))
    whole = r.pieces(data, ends)
    monkeypatch.setattr(r, "SEGMENT", 100)
    parts = r.pieces(data, ends)
    cover = lambda p: [int(a) for s, n, h in zip(*p, strict=True) for a in [h] * n]
    assert cover(whole) == cover(parts)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(None, "short", None, None)]])
def test_nothing_to_find(spark, rows):
    assert [x[2:4] for x in removed(spark.createDataFrame(rows, SCHEMA))] == [(0, 0)] * len(rows)


def shuffle_files(spark):
    return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))


def test_shuffle_files_of_a_step_go_as_it_ends(spark, monkeypatch):
    """No collector is waited for: else files of two or three steps, each about the size of the texts, stand on disk at a time."""
    before, left, setting = shuffle_files(spark), [], "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    saved, was = r.saved, spark.conf.get(setting)

    def watched(*args, **kwargs):
        out = saved(*args, **kwargs)
        end = time.time() + 5
        while shuffle_files(spark) - before and time.time() < end:
            time.sleep(0.1)
        left.append(len(shuffle_files(spark) - before))
        return out

    monkeypatch.setattr(r, "saved", watched)
    docs = corpus()
    r.remove(spark.createDataFrame([(i, t, "x", "y") for i, t in docs], SCHEMA).repartition(7))
    assert len(left) == 6 and not any(left)
    assert spark.conf.get(setting) == was


def test_buckets_are_even():
    """Anchors are least hashes; taken as they are, the first bucket got over twenty times its share."""
    data, ends = r.joined([bytes(np.random.default_rng(7).integers(0, 256, 300_000).astype(np.uint8))])
    anchor = r.pieces(data, ends)[2]
    assert np.bincount(r.bucket_of(anchor, 64), minlength=64).max() < 1.3 * len(anchor) / 64


def test_copies_are_dealt_once(spark):
    """Pieces of one batch go to a bucket as distinct ones with their least and greatest id, in less than half their bytes where they are alike."""
    rng = np.random.default_rng(8)
    text = bytes(rng.integers(97, 123, 400).astype(np.uint8))
    rows = [(a, a % 7, text[a : a + 60], i, i) for a in range(300) for i in (9, 3, 4)]
    df = spark.createDataFrame(rows, "anchor long, name long, piece binary, low long, high long").coalesce(1)
    blocks = r.dealt_pieces(df, 1).collect()
    assert [(b["bucket"], b["n"], b["size"]) for b in blocks] == [(0, 300, 300 * (4 * 8 + 1 + 60))]
    assert len(blocks[0]["block"]) < 300 * 60 / 2
    raw = pa.decompress(blocks[0]["block"], blocks[0]["size"], "zstd", asbytes=True)
    anchor, name, low, more = np.frombuffer(raw[: 300 * 32], np.int64).reshape(4, 300)
    assert anchor.tolist() == list(range(300)) and (name == anchor % 7).all()
    assert (low == 3).all() and (low + more == 9).all()
    assert [raw[300 * 33 + 60 * a :][:60] for a in range(300)] == [text[a : a + 60] for a in range(300)]


def test_stretches_of_distinct_pieces(spark):
    """Pieces alone with their anchor, copies or not, and among others."""
    text = "".join(chr(c) for c in np.random.default_rng(9).integers(97, 123, 200))
    piece = {k: bytearray(text[a:z].encode()) for k, a, z in ((1, 0, 60), (2, 5, 65), (3, 100, 160))}
    rows = [(11, 1, 8, 8), (11, 2, 4, 4), (11, 2, 6, 6), (22, 3, 5, 5), (22, 3, 5, 5), (33, 3, 5, 5), (33, 3, r.NOBODY, r.NOBODY), (44, 3, -7, r.NOBODY)]
    df = spark.createDataFrame([(a, k, piece[k], int(i), int(j)) for a, k, i, j in rows], "anchor long, name long, piece binary, low long, high long").repartition(3)
    assert {tuple(x) for x in r.stretches(df, 4).collect()} == {(11, 1, 5, 10, 4), (11, 2, 0, 10, 4), (33, 3, 0, 10, 5), (44, 3, 0, 10, -7)}
