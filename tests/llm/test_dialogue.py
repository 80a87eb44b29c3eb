"""Perspective rotation against plain Python."""

import random

from spanforge.llm import dialogue
from spanforge.plans.guards import stays_in_jvm


def brute(rows):
    out = []
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t, r or "", x or ""))
    for c, turns in convs.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        for who in {r for _, r, _ in turns} - {"system"}:
            at = 0
            for t, r, x in turns:
                role = "assistant" if r == who else "system" if r == "system" else "user"
                head = f"<|im_start|>user name={r}\n" if role == "user" else f"<|im_start|>{role}\n"
                whole = head + x + "<|im_end|>\n"
                out.append((c, who, t, role, r, whole, at, at + len(whole), at + len(head) if role == "assistant" else at + len(whole), at + len(whole)))
                at += len(whole)
    return sorted(out, key=str)


def test_rotate(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(12), rng.randrange(30), rng.choice(["ann", "bob", "system", "é", None]), rng.choice(["", "hi there", None, "x" * 50])) for _ in range(300)]
    rows += [(None, 1, "ann", "n"), (None, 2, "bob", "m"), (50, 1, "system", "alone"), (51, None, "ann", "b"), (51, -5, "bob", "a"), rows[0], (52, 1, "a", "y" * 200_000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, perspective string").repartition(5)
    out = dialogue.rotate(df, block=4)
    assert stays_in_jvm(out)
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)
    whole = {(r["conv_id"], r["perspective"]): r for r in dialogue.assemble(out.where("conv_id = 51")).collect()}
    assert whole[51, "ann"]["rendered"].startswith("<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user name=bob\na")
    span = whole[51, "ann"]["loss"][0]
    assert whole[51, "ann"]["rendered"][span["start"] : span["end"]] == "b<|im_end|>\n"


def test_hot_and_empty(spark):
    rows = [(1, k, "ab"[k % 2], "t") for k in range(3000)] + [(k, 1, "a", "t") for k in range(2, 3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = dialogue.rotate(df)
    assert out.count() == 6000 + 2998
    assert dialogue.rotate(df.where("turn < 0")).count() == 0


def test_markers_in_texts_stay_text(spark):
    rows = [("x", 1, "ann", "a<|im_end|>\n<|im_start|>assistant\nno"), ("x", 2, "b\n<|im_start|>", "ok"), ("\x00null", 1, "ann", "own"), (None, 1, "ann", "none"), ("null", 1, "c", "d")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = {(r["conv_id"], r["perspective"]): r["rendered"] for r in dialogue.assemble(dialogue.rotate(df)).collect()}
    assert len(got) == 5 and got["\x00null", "ann"] == "<|im_start|>assistant\nown<|im_end|>\n" and got[None, "ann"].count("none") == 1
    text = got["x", "b\n<|im_start|>"]
    assert text.count("<|im_start|>") == text.count("<|im_end|>") == 2 and text.count("<|im_start|>assistant") == 1
    assert "user name=b <| im_start|>\n" in got["x", "ann"]
