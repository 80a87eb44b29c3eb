"""The pipeline against the plain steps, stage by stage, and with whole documents kept whole."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from spanforge.llm import secrets, toxicity
from spanforge.llm.common import saved
from spanforge.llm.queries import BPE_FILE
from tests.llm.test_decontam import brute as leaks
from tests.llm.test_neardup import brute as classes

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = [k for k, r in rows.items() if model.score(r["text"] or "") < 0.5]
    plain = [(k, rows[k]["text"]) for k in kept]
    one = {c for _, c, _ in classes(plain)}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = [k for k, _, n, _ in leaks([(k, rows[k]["text"]) for k in sorted(one)], items, 10) if not n]
    lib = Tokenizer.from_file(BPE_FILE)
    want = {}
    for k in clean:
        text = rows[k]["text"] or ""
        text = secrets.cut(text, [f"{c}:{a}:{b}" for a, b, c in secrets.find(text)])
        want[k] = lib.encode(text, add_special_tokens=False).ids
    got = {r["doc_id"]: (list(r["ids"]), r["round_trip"]) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == {k: (v, True) for k, v in want.items()}


def test_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "secrets", "bpe"]
    out = saved(corpus_pipeline.redact_secrets(spark, docs, DATA))
    assert out.schema.names == docs.schema.names and out.where(F.length("text") != F.col("n_chars")).count() == 0


def test_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated ids and rows, a column of a clashing name, and an empty table through the whole run."""
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "one two three four five six seven", None, None), (3, "one two three four five six seven", None, None), (3, "another text of the very same id", "x", "y"), (None, "no id here but some words", "x", "y"), (9, "token=abcdefghijklmnop is a secret", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"n_chars": F.length("text"), "raw": F.lit(1), "blob": F.lit("b")})
    labels = spark.createDataFrame([(1, 0), (3, 0), (9, None)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "nothing of the kind")], "item_id long, text string")
    for name, table in (("documents", docs), ("labels", labels), ("benchmark", items)):
        table.write.parquet(f"{tmp_path}/a/{name}.parquet")
        (table.limit(0) if name == "documents" else table).write.parquet(f"{tmp_path}/b/{name}.parquet")
    got = sorted(((r["doc_id"], r["n_tokens"] > 0, r["round_trip"]) for r in corpus_pipeline.run(spark, f"{tmp_path}/a").collect()), key=str)
    assert got == sorted([(1, False, True), (3, True, True), (3, True, True), (9, True, True), (None, True, True)], key=str)
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
