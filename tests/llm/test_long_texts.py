"""Texts of a megabyte that invite patterns to read them again and again: each must take seconds, not hours."""

import time

import pytest
from pyspark.sql import functions as F

from spanforge.llm import decontam, quality, secrets, toxicity

SECONDS = 5
BEGIN, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"


@pytest.mark.parametrize("text", ["*" * 10**6, "!" * 10**6 + "a", "a* " * 300_000, "*a" * 300_000, "+1" * 300_000])
def test_suspects(text):
    began = time.perf_counter()
    toxicity.suspects(text)
    assert time.perf_counter() - began < SECONDS


@pytest.mark.parametrize("text", [BEGIN + " " * 10**6, BEGIN + "\n" + "A: b\n" * 200_000, BEGIN + "\n" + "Ab" * 500_000, (BEGIN + "\n") * 30_000, BEGIN + "\n" + "A-" * 300_000])
def test_key_blocks_without_an_end(text):
    began = time.perf_counter()
    assert not [x for x in secrets.find(text) if x[2] == "pem"]
    assert time.perf_counter() - began < SECONDS


@pytest.mark.parametrize("body", ["\nabc\n", "\nProc-Type: 4,x\nA: b\n\nabc+/=\n", "  ", "\n\n" + "Ab+/" * 1000 + "\n"])
def test_key_blocks(body):
    assert secrets.find(BEGIN + body + END) == [(0, len(BEGIN + body + END), "pem")]


def test_a_key_block_needs_a_blank_and_a_body():
    assert secrets.find(BEGIN + " " + END) == secrets.find(BEGIN + "abc" + END) == []


def test_lines_of_blanks(spark):
    text = "word" + " " * 10**6 + "word\n" + "\t" * 10**6
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    quality.clean(spark.createDataFrame([(1, "a b")], df.schema)).collect()
    began = time.perf_counter()
    assert quality.clean(df).select("n_words").first()[0] == 2
    assert time.perf_counter() - began < SECONDS


def test_items_without_an_id(spark):
    words = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, words)], "doc_id long, text string")
    items = spark.createDataFrame([(None, words[:60]), (None, words[20:]), ("b", words), ("a", "w3 w4")], "item_id string, text string")
    row = decontam.hits(docs, items).select("items", F.size("items").alias("n")).first()
    assert row["items"] == ["a", "b", None] and row["n"] == 3
    assert decontam.keep_clean(docs, items).count() == 0
