"""The window network: windows, learning, scores."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import lm


def test_windows():
    sizes = np.array([3, 0, 1])
    c, owner = lm.windows(np.array([5, 6, 7, 9], np.uint16), sizes)
    e = lm.BINS
    assert c.tolist() == [[e, e, 6, 7], [e, 5, 7, e], [5, 6, e, e], [e, e, e, e]] and owner.tolist() == [0, 0, 0, 2]


def bins_of(docs):
    """Bin and log p(word | bin) of every word, on the driver."""
    found, mass = lm.binned(lm.word_counts(lm.sliced(docs)))
    return {r["word"]: (r["bin"], r["log"]) for r in found.collect()}, mass.sum()


def zipf(n, words, seed):
    rng = random.Random(seed)
    return [" ".join(f"w{int(rng.paretovariate(0.5)) % words}" for _ in range(400)) for _ in range(n)]


def test_bins_are_distributions(spark):
    texts = zipf(80, 30000, 1)
    found, total = bins_of(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string").repartition(3))
    counts = Counter(w for t in texts for w in t.split())
    assert total == sum(counts.values()) and set(found) == set(counts)
    mass = np.zeros(lm.BINS)
    for b, log in found.values():
        mass[b] += math.exp(log)
    assert np.allclose(mass[mass > 0], 1)
    top = sorted(counts, key=lambda w: (-counts[w], w))[: lm.SINGLE * lm.MEMBERS]
    assert [found[w] for w in top] == [(k, 0.0) for k in range(len(top))]
    sums = Counter()
    for w, (b, _) in found.items():
        sums[b] += counts[w]
    assert all(math.isclose(log, math.log(counts[w] / sums[b]), abs_tol=1e-6) for w, (b, log) in found.items())


def test_score(spark):
    rng = random.Random(2)
    order = ["the", "cat", "sat", "on", "a", "mat"]
    rows = [(k, " ".join(order * rng.randrange(20, 60))) for k in range(120)] + [(500, " ".join(rng.choice(order) for _ in range(200))), (501, None), (502, "..."), (0, "the cat"), (None, "a mat")]
    out = lm.score(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int").repartition(4))
    got = {(r["doc_id"], r["n_words"]): r for r in out.collect()}
    assert len(got) == 125 and got[501, 0]["log_likelihood"] == 0 and got[501, 0]["per_word"] is None and got[502, 0]["per_word"] is None
    ordered = np.mean([r["per_word"] for (k, n), r in got.items() if n > 2 and k < 120])
    assert ordered > got[500, 200]["per_word"] and ordered > math.log(1 / 6) + 0.5
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    chains = [[f"{a}{k}" for k in range(12)] for a in "abcdef"]
    texts = [" ".join(w for _ in range(rng.randrange(2, 12)) for w in (lambda c, s: c[s:] + c[:s])(rng.choice(chains), rng.randrange(12))) for _ in range(300)]
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(900, " ".join(zipf(1, 2000, 5)) + " word" * 3000), (901, None), (902, None), (7, texts[7])], "doc_id long, text string")


def scores(docs, parts):
    return sorted((str(r["doc_id"]), r["n_words"], r["log_likelihood"]) for r in lm.score(docs.repartition(parts)).collect())


def test_partitions_do_not_matter(table, monkeypatch):
    """The same rows in 1 and in 7 partitions, several units, several slices: the same scores."""
    monkeypatch.setattr(lm, "UNIT", 4000)
    monkeypatch.setattr(lm.coded, "__defaults__", (4000,))
    one = scores(table, 1)
    monkeypatch.setattr(lm, "SLICE", 3000)
    seven = scores(table, 7)
    assert len(one) == 304 and [x[:2] for x in one] == [x[:2] for x in seven]
    assert np.allclose([x[2] for x in one], [x[2] for x in seven], rtol=1e-6, atol=1e-9)


def test_plain_recomputation(table):
    """Every document's score from the parameters, word by word, in plain Python."""
    docs = table.select(F.col("doc_id").alias("id"), "text")
    net, (found, _) = lm.train(*lm.coded(docs)), bins_of(docs)
    got = scores(table, 3)
    want = []
    for k, text in [tuple(r) for r in docs.collect()]:
        bins, total = [found[w][0] for w in (text or "").split()], sum(found[w][1] for w in (text or "").split())
        line = [lm.BINS] * lm.SIDE + bins + [lm.BINS] * lm.SIDE
        for at, b in enumerate(bins) if len(bins) < 200 else []:
            around = [line[at + x] for x in range(2 * lm.SIDE + 1) if x != lm.SIDE]
            h = np.tanh(sum(net.table[j][c].astype(float) for j, c in enumerate(around)) + net.bias)
            for z, t in ((h @ net.out + net.out_bias, b // lm.MEMBERS), (h @ net.inner[b // lm.MEMBERS] + net.inner_bias[b // lm.MEMBERS], b % lm.MEMBERS)):
                total += math.log(math.exp(z[t]) / np.exp(z).sum())
        want.append((str(k), len(bins), total))
    short = [(a, b) for a, b in zip(got, sorted(want), strict=True) if a[1] < 200]
    assert len(short) > 290 and np.allclose([a[2] for a, _ in short], [b[2] for _, b in short], rtol=1e-4)


def test_held_out_words_beat_their_counts(spark):
    """Texts that the network never saw, of the same kind: more likely than by the counts of their words alone."""
    rng = random.Random(8)
    nxt = {k: rng.sample(range(200), 3) for k in range(200)}

    def text():
        k, out = rng.randrange(200), []
        for _ in range(300):
            out.append(f"v{k}")
            k = rng.choice(nxt[k])
        return " ".join(out)

    docs = spark.createDataFrame([(k, text()) for k in range(600)], "id long, text string")
    seen = docs.where("id < 500")
    net, (found, total) = lm.train(*lm.coded(seen), rounds=6), bins_of(seen)
    counts = Counter(w for r in seen.collect() for w in r["text"].split())
    gain = []
    for r in docs.where("id >= 500").collect():
        bins = np.array([found[w][0] for w in r["text"].split()], np.uint16)
        context, _ = lm.windows(bins, np.array([len(bins)]))
        gain.append(net.log_probability(context, bins).sum() + sum(found[w][1] for w in r["text"].split()) - sum(math.log(counts[w] / total) for w in r["text"].split()))
    assert min(gain) > 0 and np.mean(gain) / 300 > 0.5


def test_masked():
    """A word's own bin is no input of its prediction."""
    net = lm.Network(seed=3)
    c, _ = lm.windows(np.array([1, 2, 3, 4, 5], np.uint16), np.array([5]))
    d, _ = lm.windows(np.array([1, 2, 9, 4, 5], np.uint16), np.array([5]))
    assert (net.hidden(c)[2] == net.hidden(d)[2]).all() and not (net.hidden(c)[1] == net.hidden(d)[1]).all()


def test_gradient(monkeypatch):
    """One step's gradient against differences of the likelihood."""
    net, rng = lm.Network(seed=5), np.random.default_rng(1)
    bins = rng.integers(0, lm.BINS, 40).astype(np.uint16)
    context, _ = lm.windows(bins, np.array([40]))
    seen = []
    keep = lm.Moments(len(net.flat))
    assert lm.LEAST < 40 < lm.BATCH
    monkeypatch.setattr(lm, "LEAST", 64)
    keep.step = lambda flat, grad, rate: seen.append(grad.copy())
    net.fit(context, bins, 0.1, keep)
    for k in [*np.argsort(-np.abs(seen[0]))[:20], *rng.integers(0, len(net.flat), 20)]:
        up, down = net.flat.copy(), net.flat.copy()
        up[k] += 0.01
        down[k] -= 0.01
        slope = -np.mean(lm.Network(up).log_probability(context, bins) - lm.Network(down).log_probability(context, bins)) / 0.02
        assert abs(slope - seen[0][k]) < 1e-3


def test_every_counted_word_has_its_own_probability(spark):
    """Beyond any number of words: the rarer of two words of equal length and end scores lower."""
    top = " ".join(f"c{k:05d} " * 4 for k in range(9000))
    docs = spark.createDataFrame([(1, top), (2, "frequented " * 3), (3, "mistakened")], "id long, text string")
    found = {i: m for r in lm.coded(docs)[0].collect() for i, m in zip(r["ids"], r["member"], strict=True)}
    of, _ = bins_of(docs)
    assert len(found) == 3 and of["frequented"][0] != of["mistakened"][0]
    assert np.isclose(found[2], 3 * of["frequented"][1]) and np.isclose(found[3], of["mistakened"][1])


def test_every_word_is_a_target():
    """With the registered parameters each place of each text is a target once over the rounds, short texts too."""
    sizes = np.array([1, 2, 0, 5, 40, 3])
    assert (sum(lm.targets(sizes, k, lm.STRIDE).astype(int) for k in range(lm.ROUNDS)) == 1).all()
    assert (lm.targets(sizes, 1, lm.STRIDE)[8:48] == lm.targets(np.array([40]), 1, lm.STRIDE)).all()
