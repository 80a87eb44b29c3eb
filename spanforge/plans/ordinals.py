"""Dense positions 1..n over a total order without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.plans.storage import written


def placed(df: DataFrame, order: list, name: str = "rid") -> tuple[DataFrame, int]:
    """``df`` with its 1-based place in the order of ``order``, and the number of rows; rows that tie in all of it may be dealt their places either way, once.

    Rows are range-partitioned, sorted and written to the shared folder, each with its place in its partition: nothing is
    kept on an executor, and places stay what they are whoever is lost. Counts of partitions (a row each) are summed up and broadcast.
    """
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    before, total = [], 0
    for p, n in sorted((r[0], r[1]) for r in rows.groupBy(part.alias("p")).agg(F.count("*")).collect()):
        before.append((p, total))
        total += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "__p long, __before long"))
    joined = rows.withColumn("__p", part).join(offsets, "__p")
    return joined.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).drop("__p", "__before", "__at"), total


def with_ordinal(df: DataFrame, order: list, name: str = "rid") -> DataFrame:
    """``df`` with its 1-based place in the order of ``order``."""
    return placed(df, order, name)[0]
