"""Windows of benchmark items in documents, against a direct search."""

import random
import re
import subprocess
import sys
from pathlib import Path

from spanforge.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def folded(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n):
    out = []
    for k, text in docs:
        words, hit, ids = folded(text), set(), set()
        for i, t in items:
            w = folded(t)
            for a in range(max(1, len(w) - n + 1) if w else 0):
                win = w[a : a + n]
                for p in range(len(words) - len(win) + 1):
                    if words[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        ids.add(str(i))
        out.append((k, len(words), len(hit), tuple(sorted(ids))))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in df.collect()), key=str)


def case():
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "Ab", "é", "É", "x1", "ab"])
    items = [(k, " ".join(word() for _ in range(rng.randrange(9)))) for k in range(8)] + [(8, None), (9, ""), (10, "!!"), (3, "zz zz")]
    docs = [(k, rng.choice([" ", ", ", "\n--"]).join(word() for _ in range(rng.randrange(40)))) for k in range(60)] + [(60, None), (61, ""), (1, "A b"), (None, "zz zz")]
    return docs, items


def tables(spark, docs, items):
    return spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, n_words string"), spark.createDataFrame(items, "item_id long, text string")


def test_hits(spark):
    docs, items = case()
    d, i = tables(spark, docs, items)
    assert rows(decontam.hits(d, i, window=3)) == brute(docs, items, 3)
    clean = decontam.keep_clean(d, i, window=3)
    assert clean.columns == d.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(k) for k, _, n, _ in brute(docs, items, 3) if not n)


def test_wide_letters(spark, monkeypatch):
    """Words in two letters, as for over a million of them; comparisons in small parts."""
    docs, items = case()
    monkeypatch.setattr(decontam, "LETTERS", 4)
    monkeypatch.setattr(decontam, "PAIRS", 3)
    a = decontam.Automaton([(str(k), t or "") for k, t in items], 3)
    got = [(k, (r := a.scan(t or ""))[0], int(r[1].sum()), tuple(sorted(r[2]))) for k, t in docs]
    assert a.width == 2 and sorted(got, key=str) == brute(docs, items, 3)


def test_windows_of_many_sizes():
    rng = random.Random(8)
    for n in (1, 2, 4, 5, 10):
        items = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(30)))) for k in range(12)]
        docs = [(k, " ".join(rng.choice("abcd") for _ in range(rng.randrange(60)))) for k in range(40)]
        docs += [(99, "x " + items[0][1] + " y " + items[1][1])]
        a = decontam.Automaton([(str(k), t) for k, t in items], n)
        assert sorted(((k, (r := a.scan(t))[0], int(r[1].sum()), tuple(sorted(r[2]))) for k, t in docs), key=str) == brute(docs, items, n)


def test_memory_of_many_items():
    """20 MB of items in one automaton: under 500 MB of a worker; and a very long text."""
    program = """
import random, resource
from spanforge.llm import decontam
rng = random.Random(1)
words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(200_000)]
items = [(str(k), " ".join(rng.choices(words, k=100))) for k in range(33_000)]
before, size = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, sum(len(t) for _, t in items)
a = decontam.Automaton(items, 10)
n, hit, ids = a.scan("start " + items[7][1] + " middle " * 400_000 + items[9][1][40:])
print(size, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before, n, int(hit.sum()) >= 180, sorted(ids) == ["7", "9"])
"""
    out = subprocess.run([sys.executable, "-c", program], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout.split()
    assert int(out[0]) > 19e6 and int(out[1]) < 500_000 and out[3:] == ["True", "True"], out


def test_many_passes(spark, monkeypatch):
    docs, items = case()
    monkeypatch.setattr(decontam, "PASS_BYTES", 20)
    d, i = tables(spark, docs + docs[:3], items)
    assert rows(decontam.hits(d, i, window=3)) == brute(docs + docs[:3], items, 3)


def test_spans(spark):
    d, i = tables(spark, [(1, "É x, One  TWO-three! x two"), (2, "")], [(5, "one two three")])
    got = {r["doc_id"]: list(r["spans"]) for r in decontam.hits(d, i).collect()}
    assert got == {1: [5, 19], 2: []}


def test_empty(spark):
    d, i = tables(spark, [(1, "a b")], [])
    assert rows(decontam.hits(d, i)) == [(1, 2, 0, ())]
    d, i = tables(spark, [], [(1, "a")])
    assert decontam.hits(d, i).count() == 0
