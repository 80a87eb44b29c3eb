"""Deobfuscation on planted disguises, and held-out accuracy on planted words."""

import random

import numpy as np
import pytest

from spanforge.llm import toxicity

WORDS = [a + b + c for a in ("al", "bro", "ca", "de", "fli", "gra") for b in ("ber", "nto", "ri", "sa", "mu") for c in ("ne", "k", "dor", "lly", "s")]
BAD = ["idiot", "worthless", "stupid", "moron", "pathetic"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    rows = []
    for k in range(1500):
        w = [rng.choice(WORDS) for _ in range(rng.randrange(5, 80))]
        toxic = k % 5 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(BAD)
        rows.append((k, " ".join(w) + ".", int(toxic)))
    docs = spark.createDataFrame([(a, b, "lang") for a, b, _ in rows], "doc_id long, text string, toxic string").repartition(4)
    labels = spark.createDataFrame([(a, c) for a, _, c in rows if a % 3] + [(None, 1), (2, None), (4, 0), (4, 0)], "doc_id long, toxic int")
    return rows, docs, labels, toxicity.train(docs, labels)


def test_held_out(spark, corpus):
    rows, docs, labels, model = corpus
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [(got[k] >= 0.5) == bool(y) for k, _, y in rows if toxicity.held_out(k)]
    assert len(held) > 200 and np.mean(held) > 0.97
    assert all(0 <= x <= 1 for x in got.values())
    clean = toxicity.keep_clean(docs, model)
    assert clean.columns == docs.columns and abs(clean.count() - 1200) < 20


def test_disguises(corpus):
    model = corpus[3]
    for told, meant in (("1d10t", "idiot"), ("w0rthl3ss", "worthless"), ("$tupid", "stupid"), ("s.t.u.p.i.d", "stupid"), ("m o r o n", "moron"), ("stuuuupid", "stupid"), ("p@thet1c", "pathetic")):
        assert model.channel.text(f"alberne {told} gramus.") == f" alberne {meant} gramus "
        assert model.score(f"alberne {told} gramus") > 0.5 > model.score("alberne gramus")
    plain = "brontok saddle book 2024 10% a b 0x12"
    assert model.channel.text(plain).split()[:4] == ["brontok", "saddle", "book", "2024"]


def test_more_disguises(corpus):
    """Ends, doubled letters, long rows of letters, words between them, long runs: whatever the length."""
    c = corpus[3].channel
    spaced = lambda x, by=" ": by.join(x)
    for told, meant in (("idi0t", "idiot"), ("m0r0n!", "moron"), ("mor0n", "moron"), ("iiddiioott", "idiot"), ("m" + "o" * 60 + "ron", "moron"), (spaced("pathetic", "-"), "pathetic"), (spaced("idiot", "*"), "idiot")):
        assert c.text(f"alberne {told} gramus.") == f" alberne {meant} gramus ", told
    long = "stupid" * 30
    assert len(spaced(long)) > 300 and c.text(spaced(long)).replace(" ", "") == long
    assert " moron " in c.text("brontok a m o r o n brontok") or " amoron " in c.text("brontok a m o r o n brontok")
    assert corpus[3].score("brontok w 0 r t h 1 e s s brontok") > 0.5
    for x in ("a b c", "2024", "10%", "9f86d081884c7d659f86d081884c7d65"):
        assert corpus[3].score(x) < 0.5


def readings_of(channel, s, spaced):
    """All outputs with their costs, by trying every path."""
    lattice, n = channel.lattice(s, spaced), len(s)
    found = {}

    def walk(k, out, cost):
        if k == n:
            cost += channel.cost[tuple(toxicity.letter_class(c) if c else 0 for c in ("", "", *out)[-2:])][0]
            found[out] = min(found.get(out, np.inf), cost)
            return
        again = k > 0 and s[k] == s[k - 1]
        run = again and (k > 1 and s[k - 2] == s[k] or k + 1 < n and s[k + 1] == s[k])
        for x, extra in lattice[k]:
            if not x:
                walk(k + 1, out, cost + extra)
                continue
            a, b = ("", "", *out)[-2:]
            lm = channel.cost[toxicity.letter_class(a) if a else 0, toxicity.letter_class(b) if b else 0, toxicity.letter_class(x)]
            walk(k + 1, (*out, x), cost + extra + lm + (toxicity.KEEP if a == b == x else 0))
            if again and b == x:
                walk(k + 1, out, cost + extra + (toxicity.DROP if run else toxicity.TWICE))

    walk(0, (), 0.0)
    return {"".join(k): v for k, v in found.items()}


def test_search_is_exact(corpus):
    """Against every path through the lattice, for stretches of up to 8 characters."""
    c, rng = corpus[3].channel, random.Random(3)
    for _ in range(250):
        spaced = rng.random() < 0.3
        s = "".join(rng.choice("aioostm01$!*3é") for _ in range(rng.randrange(1, 8)))
        if rng.random() < 0.4:
            s = "".join(x * rng.choice([1, 2, 3]) for x in s)[:8]
        if spaced:
            s = " ".join(s[:4])
        every = readings_of(c, s, spaced)
        cost, out = c.viterbi(s, spaced)
        assert np.isclose(cost, min(every.values()), rtol=1e-5) and np.isclose(every[out], cost, rtol=1e-5), s


def test_plain_scorer(corpus):
    """Scores from the features of the restored text, without the automaton."""
    rows, model = corpus[0], corpus[3]
    for _, text, _ in rows[:200]:
        have = [model.weights[f] for f in toxicity.features(model.channel.text(text)) if f in model.weights]
        want = 1 / (1 + np.exp(-np.clip(model.bias + sum(w for w, _ in have), -30, 30)))
        assert np.isclose(model.score(text), max([want, *(s for _, s in have if s >= toxicity.SURE)]))


def test_learnt_sample_is_bounded(spark, corpus):
    """An id on very many rows is one row to learn from."""
    docs = spark.createDataFrame([(1, "moron"), (1, "alberne")] * 500 + [(k, "brontok saddle") for k in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k == 1)) for k in range(40)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, max_train=10)
    assert 0 <= model.score("moron") <= 1


def test_odd_rows(spark, corpus):
    model = corpus[3]
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (2, ""), (3, "idiot " * 30_000)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["score"]) for r in toxicity.score(docs, model).collect()), key=str)
    assert len(got) == 5 and got[0][1] == got[1][1] == got[2][1] < 0.5 < got[3][1]
    assert toxicity.score(docs.where("doc_id = 99"), model).count() == 0
    none = toxicity.train(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert none.score("anything") < 0.5
    assert toxicity.train(docs.where("doc_id = 99"), spark.createDataFrame([], "doc_id long, toxic int")).score("x") == 0.5
