"""Sources and sinks of ranges: Parquet, CSV (also gzipped), tables, DataFrames, rows in memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.plans.ordinals import with_ordinal

ROLES = ("seqnames", "start", "end", "strand")


def source(spark: SparkSession, data: str | DataFrame) -> DataFrame:
    """A DataFrame as it is, ``*.csv``/``*.csv.gz``/``*.tsv`` by reader with header, ``table:name`` from the catalog, anything else as Parquet."""
    if isinstance(data, DataFrame):
        return data
    if data.startswith("table:"):
        return spark.table(data[6:])
    plain = data.removesuffix(".gz")
    if plain.endswith((".csv", ".tsv", ".txt")):
        return spark.read.csv(data, header=True, inferSchema=True, sep="," if plain.endswith(".csv") else "\t")
    return spark.read.parquet(data)


def role(given: str | Column | int | None, default: object) -> Column:
    """A column name, any expression, a literal, or the default."""
    if given is None:
        return F.lit(default)
    if isinstance(given, str):
        return F.col(given)
    return given if isinstance(given, Column) else F.lit(given)


def third(start, end, width) -> tuple[object, object]:
    """Start and end expressions from exactly two of the three, or from start alone (points)."""
    given = [x is not None for x in (start, end, width)]
    if given == [True, True, False]:
        return role(start, None), role(end, None)
    if given == [True, False, True]:
        return role(start, None), role(start, None) + role(width, None) - 1
    if given == [False, True, True]:
        return role(end, None) - role(width, None) + 1, role(end, None)
    if given == [True, False, False]:
        return role(start, None), role(start, None)
    raise ValueError("give exactly two of start, end and width, or start alone")


def bind(df: DataFrame, *, seqnames=None, start=None, end=None, width=None, strand=None, key: str | None = None, mcols: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """A frame of ranges: rid (place in the order), seqnames, start, end, strand, then metadata columns.

    The order is that of ``order``, else of ``key``, else of the coordinates and metadata; a long column named
    rid is taken as the place as it is.
    """
    lo, hi = third(start, end, width)
    mcols = list(mcols or ())
    keep = [c for c in ([key] if key else []) + mcols if c not in (*ROLES, "rid")]
    out = df.select(
        *(["rid"] if "rid" in df.columns and order is None and key in (None, "rid") else []), role(seqnames, "").cast("string").alias("seqnames"), lo.cast("int").alias("start"), hi.cast("int").alias("end"),
        role(strand, "*").cast("string").alias("strand"), *dict.fromkeys(keep), *[F.col(c).alias(f"__o{k}") for k, c in enumerate(order or ()) if c not in keep],
    )
    if "rid" in out.columns:
        return out
    by = [c if c in keep else f"__o{k}" for k, c in enumerate(order)] if order else [key] if key else [*ROLES, *keep]
    placed = with_ordinal(out, by)
    return placed.select("rid", *ROLES, *dict.fromkeys(keep))


def from_rows(spark: SparkSession, rows: list[tuple], mcols: str = "") -> DataFrame:
    """Ranges from (seqnames, start, end, strand, ...) tuples in memory, in the order given."""
    schema = "rid long, seqnames string, start int, end int, strand string" + (f", {mcols}" if mcols else "")
    return spark.createDataFrame([(k + 1, *r) for k, r in enumerate(rows)], schema)


def write(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Parquet, one folder per sequence if asked, so that a filter on it prunes files."""
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
