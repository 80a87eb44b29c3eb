"""Counts after edits against counting the edited text from the start."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanforge.llm import bpe, tokencount

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def lib():
    t = Tokenizer.from_file(PATH)
    return lambda x: len(t.encode(x, add_special_tokens=False).ids)


def test_trees(lib):
    counter, rng = tokencount.Counter(bpe.SpeculativeBPE(PATH)), random.Random(1)
    letters = [*"abc  'restlvmd \n\t,.12é日", "<|endoftext|>", "<|endof", "text|>"]
    some = lambda sizes: "".join(rng.choice(letters) for _ in range(rng.choice(sizes)))
    for _ in range(150):
        want = some([0, 1, 5, 50, 3000])
        tree = tokencount.Tree.of(want, counter)
        for _ in range(6):
            n = len(want)
            s = rng.randrange(-2, n + 3)
            e = s + rng.choice([0, 1, 3, 30, 800])
            new = some([0, 1, 3, 10, 600])
            a = min(max(s, 0), n)
            want = want[:a] + new + want[min(max(e, a), n) :]
            tree.replace(s, e, new)
            text, sizes, leaves = tree.stored()
            sizes, leaves = np.frombuffer(sizes, "<u4").reshape(2, -1), np.frombuffer(leaves, "<u4").reshape(3, -1)
            assert text == want and tree.tokens[1] == lib(want) == sizes[1].sum()
            assert sizes[0].tolist() == [len(x) for x in counter.bpe.pieces(want)]
            at = np.cumsum([0, *leaves[0]])
            assert [(sizes[0, x:y].sum(), sizes[1, x:y].sum()) for x, y in zip(at[:-1], at[1:], strict=True)] == [*map(tuple, leaves[1:].T)]
            assert tree.tokens[1:] == [tree.tokens[2 * k] + tree.tokens[2 * k + 1] if k < tree.width else tree.tokens[k] for k in range(1, 2 * tree.width)]
            if rng.random() < 0.3:
                tree = tokencount.Tree(text, sizes, leaves, counter)


def test_local_work():
    counter = tokencount.Counter(bpe.SpeculativeBPE(PATH))
    tree = tokencount.Tree.of("some words here. " * 20_000, counter)
    tree.replace(100_000, 100_005, "new")
    assert tree.reencoded < 16
    assert sum(x is not None for x in tree.own) < 4
    tree.replace(50_000, 150_000, "")
    assert tree.reencoded < 32 and tree.chars[1] == 240_000 - 2


def test_kept_trees_are_never_split_again(spark, lib, monkeypatch, tmp_path):
    """A later run reads the table of trees; whole texts do not pass the splitter any more."""
    docs = spark.createDataFrame([(k, "Some words of a text. " * (50 * k), "x") for k in range(4)], "doc_id long, text string, sizes_of string")
    tokencount.trees(docs, PATH).write.parquet(str(tmp_path / "a"))
    kept = spark.read.parquet(str(tmp_path / "a")).withColumn("edits", tokencount.sample_edits(F.col("doc_id"), F.length("text")))
    tokencount.edit(kept, "edits", PATH).write.parquet(str(tmp_path / "b"))
    again = spark.read.parquet(str(tmp_path / "b"))
    assert again.columns == ["doc_id", "text", "sizes_of", "sizes", "leaves", "n_pretokens", "n_tokens", "n_before", "n_reencoded"]
    again = tokencount.edit(again.drop("n_before", "n_reencoded").withColumn("e", tokencount.sample_edits(F.col("doc_id") + 7, F.length("text"))), "e", PATH).collect()
    assert all(r["n_tokens"] == lib(r["text"]) for r in again)
    assert all(r["n_reencoded"] <= 60 for r in again)
    counter = tokencount.Counter(bpe.SpeculativeBPE(PATH))
    row = spark.read.parquet(str(tmp_path / "a")).where("doc_id = 3").first()
    monkeypatch.setattr(counter.bpe, "pieces", None)
    tree = tokencount.Tree(row["text"], np.frombuffer(row["sizes"], "<u4").reshape(2, -1), np.frombuffer(row["leaves"], "<u4").reshape(3, -1), counter)
    tree.replace(1000, 1010, "other words")
    assert tree.tokens[1] == lib(tree.stored()[0])


def test_very_long_texts_and_clashes(spark, lib):
    long = "word " * 300_000 + "x" * 200_000
    docs = spark.createDataFrame([(1, long)], "doc_id long, text string").withColumn("edits", F.expr("array(named_struct('seq', 1L, 'start', 700000L, 'end', 700001L, 'new', 'yy'))"))
    r = tokencount.recount(docs, "edits", PATH).first()
    assert r["n_before"] == lib(long) and r["n_after"] == lib(r["edited"]) and r["n_reencoded"] < 20
    with pytest.raises(ValueError):
        tokencount.trees(docs.withColumn("sizes", F.lit(1)), PATH)


def test_recount(spark, lib):
    docs = spark.createDataFrame([(1, "Hello world <|endoftext|>", "a"), (2, None, "b"), (3, "", None), (3, "", None)], "doc_id long, text string, edits_of string")
    edits = spark.createDataFrame([(1, 1, 0, 5, "Goodbye"), (1, 2, 7, 7, "!!"), (3, 1, None, None, "new text"), (2, 1, 5, 9, None), (9, 1, 0, 0, "x")], "doc_id long, seq long, start long, end long, new string")
    got = sorted((r["doc_id"], r["n_before"], r["n_after"], r["edited"]) for r in tokencount.recount(tokencount.with_edits(docs, edits), "edits", PATH).collect())
    after = "Goodbye!! world <|endoftext|>"
    assert got == [(1, lib("Hello world <|endoftext|>"), lib(after), after), (2, 0, 0, ""), (3, 0, lib("new text"), "new text"), (3, 0, lib("new text"), "new text")]
    every = docs.withColumn("edits", tokencount.sample_edits(F.col("doc_id"), F.length(F.coalesce("text", F.lit("")))))
    assert all(r["n_after"] == lib(r["edited"]) for r in tokencount.recount(every, "edits", PATH).collect())
    assert tokencount.recount(every.where("doc_id > 10"), "edits", PATH).count() == 0
