"""The speculative encoder against the tokenizers library."""

import json
import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanforge.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return Tokenizer.from_file(PATH), bpe.SpeculativeBPE(PATH)


def agree(both, texts):
    lib, own = both
    for x, ids in zip(texts, own.encode_batch(texts), strict=True):
        ids = np.frombuffer(ids, "<u4").tolist()
        assert ids == lib.encode(x, add_special_tokens=False).ids, repr(x[:80])
        assert own.decode(np.array(ids, np.uint32)) == lib.decode(ids, skip_special_tokens=False)


def test_cases(both):
    agree(both, ["", " ", "  a", "a  ", "\n\n \n", "don't we'll I'M", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "aaaaaaaaaaaaaaaaaaaaaaaa", "hellohellohello " * 50, "x" * 3000, "\x00\x85   \x1c\x1f", "é" * 300, "日本語テキスト 👩‍👩‍👧", "1²Ⅷ½ ①", "�﻿", "_-_-_" * 99])


def test_random(both):
    rng = random.Random(5)
    for letters in ("ab ", "aeiounrst'", "the and ing\n\t  ", "0123456789.,$", "".join(map(chr, range(32, 0x250)))):
        agree(both, ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(300)])


def test_every_plane_character(both):
    agree(both, ["".join(f"a{chr(c)} {chr(c)}" for c in range(at, at + 256)) for at in [*range(0, 0xD800, 256), *range(0xE000, 0x10000, 256), 0x1D400, 0x1F600]])


def test_checks_find_failures(both):
    own = bpe.SpeculativeBPE(PATH)
    words = ["".join(random.Random(k).choices("abcdefghijklmnoprstuw", k=8)) for k in range(3000)]
    own.encode_batch(words)
    assert 0 < own.failed < own.checked


def test_odd_rows(spark, both):
    """Nulls, empty and very long texts, repeats, extra columns, an empty table, null ids; clashing names are refused."""
    lib, _ = both
    long = "lorem ipsum " * 50_000 + "y" * 100_000
    rows = [(1, None, "a", 1), (2, "", "a", 2), (3, "twice said", "b", 3), (3, "twice said", "b", 3), (None, "no id", None, None), (4, long, "c", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, source int").repartition(3)
    coded = bpe.encode(docs, PATH, check_col="same")
    got = sorted(((r["doc_id"], tuple(r["ids"]), r["same"], r["n_tokens"], r["source"]) for r in coded.collect()), key=str)
    assert got == sorted([(k, tuple(lib.encode(t or "", add_special_tokens=False).ids), True, n, s) for k, t, n, s in rows], key=str)
    back = bpe.decode(coded.unionByName(coded.limit(1).withColumns({"ids": F.lit(None).cast("array<int>"), "doc_id": F.lit(77).cast("long")})), PATH)
    assert all(r["decoded"] == (r["text"] or "") if r["doc_id"] != 77 else r["decoded"] == "" for r in back.collect())
    assert bpe.round_trip(docs, PATH).count() == 6 and bpe.round_trip(docs.where("doc_id > 9"), PATH).count() == bpe.encode(docs.where("doc_id > 9"), PATH).count() == 0
    for wrong in (lambda: bpe.encode(docs.withColumn("ids", F.lit(1)), PATH), lambda: bpe.decode(coded.withColumn("decoded", F.lit("")), PATH)):
        with pytest.raises(ValueError):
            wrong()


def test_files_that_ask_for_more_are_refused(tmp_path):
    spec = json.loads(Path(PATH).read_text())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}}, {"post_processor": {"type": "TemplateProcessing"}}, {"decoder": None}):
        (tmp_path / "v.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            bpe.SpeculativeBPE(str(tmp_path / "v.json"))


def test_side_by_side_merging_is_exact(both):
    """Words of one length merged together, by the greedy automaton and one by one: the same tokens."""
    own, rng = both[1], random.Random(6)
    words = list({"".join(rng.choice("aeinorst'h é日") for _ in range(rng.randrange(1, 30))) for _ in range(4000)})
    raw = [w.encode() for w in words]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.exact_many(raw)] == [own.exact(w) for w in raw]
    flat, owner = own.greedy_many(raw)
    cuts = np.searchsorted(owner, np.arange(len(raw) + 1))
    assert [flat[x:y].tolist() for x, y in zip(cuts[:-1], cuts[1:], strict=True)] == [own.greedy(w) for w in raw]
    assert {w: np.frombuffer(x, "<u4").tolist() for w, x in own.encode_words(words).items()} == {w: own.exact(w.encode()) for w in words}
