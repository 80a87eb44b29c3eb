"""Line-first cleaning against plain Python."""

import random
import re

from spanforge.llm import quality
from spanforge.plans.guards import stays_in_jvm

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(t):
    return [w for w in SPACE.split(t) if w]


def bad_line(line):
    n, t = len(words(line)), SPACE.sub(" ", line).rstrip()
    symbols, bars = sum(c in quality.SYMBOLS for c in line), sum(c in "|»›•·" for c in line)
    upper, lower = sum(c.isupper() for c in line), sum(c.islower() for c in line)
    return bool(
        n < 8 and not re.search(quality.ENDS.replace(r"\z", r"\Z"), t) or symbols >= 3 and 10 * symbols > 3 * n or bars >= 3 and 5 * bars > n or n <= 6 and re.search(quality.NAVIGATION.replace(r"\z", r"\Z"), line)
        or n <= 25 and re.search(quality.BOILERPLATE, line) or n >= 3 and upper > 2 * lower
    )


def brute(text):
    text = text or ""
    w = words(text)
    wins = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    again = {k + j for k, x in enumerate(wins) if wins.count(x) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    seen, dup, lost, kept_lines = set(), 0, 0, []
    for x in lines:
        fail = x in seen or bad_line(x)
        dup += x in seen
        seen.add(x)
        lost += sum(map(len, words(x))) if fail else 0
        kept_lines += [] if fail else [x]
    chars = sum(map(len, w))
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), chars, sum(c in quality.SYMBOLS for c in text), dup, len(again), failed, lost, "\n".join(kept_lines), not failed and lost <= 0.5 * chars


def test_against_python(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t ", "\x0b a\x0c b", "one line only", "Home\nMenu | a | b | c\nAll rights reserved.\n" * 3]
    for _ in range(150):
        vocabulary = [rng.choice(["alpha", "Beta", "GAMMA", "x|", "y%", "é", "«z»"]) + str(rng.randrange(30)) for _ in range(rng.choice([3, 20, 200]))]
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(14))) + rng.choice([".", "", "!", "\r", '."']) for _ in range(rng.randrange(20))]
        texts.append("\n".join(lines + rng.sample(lines, min(len(lines), rng.randrange(4)))))
    texts.append("word " * 30_000)
    rows = list(enumerate(texts[:-1]))
    docs = spark.createDataFrame([(*r, "c", 1) for r in [*rows, (0, "twice"), (0, "twice")]], "doc_id long, text string, lines string, h int")
    out = quality.clean(docs)
    assert stays_in_jvm(out)
    got = sorted(tuple(r[1:]) for r in out.collect())
    assert got == sorted([brute(t) for _, t in rows] + [brute("twice")] * 2)


def test_long_and_empty(spark):
    docs = spark.createDataFrame([(1, "word " * 60_000), (2, "\n".join(f"Line {k % 7} is here with some more words." for k in range(20_000)))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.clean(docs).collect()}
    assert got[1]["n_words"] == got[1]["n_repeat_words"] == 60_000 and not got[1]["kept"]
    assert got[2]["n_dup_lines"] == 19_993
    assert quality.clean(docs.where("doc_id = 9")).count() == 0
