"""Near-duplicate classes against all pairs."""

import random

import numpy as np

from spanforge.llm import neardup
from spanforge.llm.common import FOLD


def shingles(text):
    w = (text or "").encode().translate(FOLD).split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows, t=0.8):
    sets = [shingles(x) for _, x in rows]
    at = list(range(len(rows)))

    def find(k):
        while at[k] != k:
            k = at[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or len(a & b) >= t * len(a | b) > 0:
                at[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(k)
    ids = {k: min((rows[x][0] for x in g if rows[x][0] is not None), default=None) for g in groups.values() for k in g for g in [g]}
    return sorted(((rows[k][0], ids[k], len(groups[find(k)])) for k in range(len(rows))), key=str)


def corpus():
    rng = random.Random(11)
    words = ["w%d" % k for k in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 6, 30, 120]))] for _ in range(40)]
    rows = []
    for k in range(260):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((1000 - k, " ".join(w)))
    # A chain: each text close to the next, the ends far apart.
    chain = [rng.choice(words) for _ in range(200)]
    for k in range(12):
        chain = chain[6:] + [rng.choice(words) for _ in range(6)]
        rows.append((2000 + k, " ".join(chain)))
    return rows + [(5000, None), (5001, ""), (5002, "..."), (5003, "One, two!"), (5004, "one TWO"), (700, rows[3][1]), (None, rows[5][1]), (None, "lonely words without an id here")]


def test_classes(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, n int").repartition(6)
    got = sorted((tuple(r) for r in neardup.classes(docs).collect()), key=str)
    assert got == brute(rows)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for i, c, _ in brute(rows) if c is not None}
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(want)
    # The row without an id whose text has a copy with one goes, the lonely one stays.
    assert [r["text"] for r in kept.where("doc_id is null").collect()] == ["lonely words without an id here"]


def test_keep_one_of_odd_ids(spark):
    """Copies without ids, one id on different texts, the same row again and again."""
    a, b, c = ("one two three four five six seven", "alpha beta gamma delta epsilon zeta", "x y z u v w")
    rows = [(None, a), (None, a.upper()), (1, b), (1, c), (2, c), (2, b), (3, "same row"), (3, "same row"), (3, "same row")]
    docs = spark.createDataFrame([(*r, "raw", 5) for r in rows], "doc_id long, text string, raw string, kept_id int").repartition(3)
    kept = neardup.keep_one(docs)
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert kept.columns == docs.columns and got[:3] == [(1, b), (1, c), (3, "same row")]
    assert len(got) == 4 and got[3][0] is None and got[3][1].lower() == a


def test_banding_recall():
    """Pairs at the threshold share a band: measured, also where words repeat a thousand times."""
    texts = []
    for k in range(400):
        shared, own = [f"s{k}x{j}" for j in range(104)], [f"o{k}x{j}" for j in range(12)]
        texts += [" ".join(shared), " ".join(shared + own + [own[-1]] * (1000 if k % 2 else 1))]
    owner, shingle, _ = neardup.distinct(*neardup.shingles([t.encode() for t in texts]))
    sets = [set(shingle[owner == k].tolist()) for k in range(len(texts))]
    bands = neardup.band_keys(neardup.signatures(owner, shingle, np.ones(len(owner)), len(texts)))
    near = [(2 * k, 2 * k + 1) for k in range(400) if len(sets[2 * k] & sets[2 * k + 1]) >= 0.8 * len(sets[2 * k] | sets[2 * k + 1])]
    assert len(near) == 400 and sum(bool(set(bands[a]) & set(bands[b])) for a, b in near) / len(near) > 0.99


def test_very_long_text(spark):
    long = " ".join(f"w{k % 30011}" for k in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short")], "doc_id long, text string")
    assert sorted(tuple(r) for r in neardup.classes(docs).collect()) == [(1, 1, 2), (2, 1, 2), (3, 3, 1)]


def test_hot_group(spark):
    rng = random.Random(2)
    words = [rng.choice("abcdefghijklmnop") * rng.randrange(1, 6) for _ in range(300)]
    rows = []
    for k in range(1500):
        w = list(words)
        w[rng.randrange(300)] = f"new{k}"
        rows.append((k, " ".join(w if k % 2 else [f"other{k}", *map(str, range(k, k + 40))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in neardup.classes(docs).collect()}
    assert all(got[k] == (1, 750) for k in range(1, 1500, 2))
    brute_even = {k: v for k, v in got.items() if k % 2 == 0}
    want = {i: (c, n) for i, c, n in brute([r for r in rows if r[0] % 2 == 0][:200])}
    assert all(brute_even[k][0] == want[k][0] for k in list(want)[:150])


def test_repeated_passages(spark):
    """Repeats inside a text do not hide a pair: plain Jaccard 0.83 and more, that of 1 + ln(count) 0.4."""
    rng = random.Random(5)
    rows = []
    for k in range(12):
        shared, own = [f"s{k}x{j}" for j in range(104)], [f"o{k}x{j}" for j in range(16)]
        rows += [(2 * k, " ".join(shared)), (2 * k + 1, " ".join(shared + own * 400))]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert all(n == 2 for _, _, n in want)
    assert sorted((tuple(r) for r in neardup.classes(docs).collect()), key=str) == want


def test_registers_estimate():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 1 << 62, 100).astype(np.uint64)])
    owner = np.repeat([0, 1], 400)
    r = neardup.signatures(owner, np.concatenate([a, b]), np.ones(800), 2, 4000)
    assert abs((r[0] == r[1]).mean() - 0.6) < 0.03


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.classes(docs).count() == 0 and neardup.keep_one(docs).count() == 0
