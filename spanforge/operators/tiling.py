"""One range to many: tiles and sliding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators.intra import positive


def tile(df: DataFrame, n: int | None = None, width: int | None = None) -> DataFrame:
    """(rid, part, seqnames, start, end, strand): ``n`` tiles of nearly equal width, or as many as keep within ``width``."""
    if (n is None) == (width is None) or (n or width) < 1:
        raise ValueError("give one of n and width, positive")
    wide = (F.col("end") - F.col("start") + 1).cast("long")
    count = F.lit(n).cast("long") if n else F.greatest(F.ceil(wide / F.lit(width)), F.lit(1)).cast("long")
    rows = df.withColumn("__w", wide).withColumn("__n", count).withColumn("part", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    cut = lambda k: F.col("start") + F.floor(k * F.col("__w") / F.col("__n"))
    return rows.select("rid", F.col("part").cast("int").alias("part"), "seqnames", cut(F.col("part") - 1).cast("int").alias("start"), (cut(F.col("part")) - 1).cast("int").alias("end"), "strand")


def sliding_windows(df: DataFrame, width: int, step: int = 1) -> DataFrame:
    """(rid, part, …): windows of ``width`` every ``step`` bases; the last is cut at the end of the range."""
    positive(width=width - 1, step=step - 1)
    wide = F.col("end") - F.col("start") + 1
    last = F.ceil(F.greatest(wide - width, F.lit(0)) / F.lit(step)).cast("int")
    rows = df.withColumn("__k", F.explode(F.sequence(F.lit(0), last)))
    lo = F.col("start") + F.col("__k") * step
    return rows.select("rid", (F.col("__k") + 1).alias("part"), "seqnames", lo.alias("start"), F.least(lo + (width - 1), F.col("end")).alias("end"), "strand")
