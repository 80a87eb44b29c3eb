"""Ranges over the test tables, as Spark frames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.plans.ordinals import with_ordinal

LENGTHS = {"chr1": 200000, "chr2": 150000, "chr3": 100000, "chr4": 160000, "chr5": None, "chr6": 120000}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def li(spark: SparkSession, sf_dir: str, place: bool = True) -> DataFrame:
    """One interval per line item; ``place`` adds the dense rid, which costs a sort."""
    t = table(spark, sf_dir, "lineitem")
    at = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    cols = [
        F.concat(F.lit("chr"), (1 + F.col("l_suppkey") % 5).cast("string")).alias("seqnames"), at.cast("int").alias("start"), (at + F.col("l_quantity").cast("int") - 1).cast("int").alias("end"),
        F.when(F.col("l_linenumber") % 3 == 0, "+").when(F.col("l_linenumber") % 3 == 1, "-").otherwise("*").alias("strand"), F.col("l_extendedprice").alias("score"),
    ]
    if not place:
        return t.select(*cols, "l_orderkey")
    by = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return with_ordinal(t.select(*by, "l_quantity"), [F.col(c) for c in by]).select("rid", *cols, "l_orderkey")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events")
    at = F.col("event_id") * 15
    kind = F.when(F.col("event_type") == "click", "+").when(F.col("event_type") == "view", "-").otherwise("*")
    return t.select(
        (F.col("event_id") + 1).alias("rid"), F.concat(F.lit("chr"), (1 + F.col("user_id") % 6).cast("string")).alias("seqnames"), (at + 1).cast("int").alias("start"),
        (at + F.greatest(F.lit(1), F.floor(F.abs("value")).cast("int"))).cast("int").alias("end"), kind.alias("strand"), F.col("value").alias("score"),
    )


def pt(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders")
    at = (F.col("o_orderkey") * 10 + 1).cast("int")
    return t.select((F.col("o_orderkey") + 1).alias("rid"), F.concat(F.lit("chr"), (1 + F.col("o_custkey") % 5).cast("string")).alias("seqnames"), at.alias("start"), at.alias("end"), F.lit("*").alias("strand"))


def py(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = (10 * (F.col("rid") % 3)).cast("int")
    return ev(spark, sf_dir).select("rid", "seqnames", (F.col("start") + off).alias("start"), (F.col("end") + off).alias("end"), F.when(F.col("rid") % 4 == 0, "*").otherwise(F.col("strand")).alias("strand"))


def lg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by order, arrays in the order of places."""
    from spanforge.operators.lists import split

    return split(li(spark, sf_dir), "l_orderkey")


def si(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, v, n == "chr6") for n, v in LENGTHS.items()], "seqnames string, seqlength int, is_circular boolean")


VIEWS = """
li AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rid, 'chr' || (1 + l_suppkey % 5) AS seqnames,
  CAST(l_orderkey * 10 + l_linenumber AS INT) AS start, CAST(l_orderkey * 10 + l_linenumber + CAST(l_quantity AS INT) - 1 AS INT) AS "end",
  CASE l_linenumber % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '*' END AS strand, l_extendedprice AS score, l_orderkey FROM lineitem),
ev AS (SELECT event_id + 1 AS rid, 'chr' || (1 + user_id % 6) AS seqnames, CAST(event_id * 15 + 1 AS INT) AS start, CAST(event_id * 15 + greatest(1, CAST(floor(abs(value)) AS INT)) AS INT) AS "end",
  CASE event_type WHEN 'click' THEN '+' WHEN 'view' THEN '-' ELSE '*' END AS strand, value AS score FROM events),
pt AS (SELECT o_orderkey + 1 AS rid, 'chr' || (1 + o_custkey % 5) AS seqnames, CAST(o_orderkey * 10 + 1 AS INT) AS start, CAST(o_orderkey * 10 + 1 AS INT) AS "end", '*' AS strand FROM orders),
py AS (SELECT rid, seqnames, CAST(start + 10 * (rid % 3) AS INT) AS start, CAST("end" + 10 * (rid % 3) AS INT) AS "end", CASE WHEN rid % 4 = 0 THEN '*' ELSE strand END AS strand FROM ev),
si AS (SELECT * FROM (VALUES ('chr1', 200000, false), ('chr2', 150000, false), ('chr3', 100000, false), ('chr4', 160000, false), ('chr5', NULL, false), ('chr6', 120000, true)) AS t(seqnames, seqlength, is_circular))"""
