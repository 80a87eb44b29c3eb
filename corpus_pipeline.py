"""A corpus pipeline over documents: toxicity, near duplicates, benchmark leaks, secrets, tokens.

Each stage takes what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import bpe, decontam, neardup, secrets, toxicity
from spanforge.llm.common import drop_saved, saved
from spanforge.llm.queries import BPE_FILE, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; null and empty texts score by the bias alone, repeated rows alike. Labels of rows that are gone are not used."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies: the least id, rows without an id last; null, empty and wordless texts are copies of one another."""
    return neardup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts have none."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by [SECRET]; n_chars, where there is one, follows the text. Null texts stay null."""
    found, _ = secrets.scan(docs)
    clean = secrets.redact(docs, found)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and whether decoding the ids gives the text again; null and empty texts have no ids."""
    coded = bpe.encode(docs.select("doc_id", "text"), BPE_FILE, check_col="round_trip")
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontaminate", drop_leaks), ("secrets", redact_secrets), ("bpe", encode)]

#: A trained classifier decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents: what each keeps is written, read by the next one and deleted after it. An empty table gives an empty result."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
        if last is not None:
            drop_saved(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
