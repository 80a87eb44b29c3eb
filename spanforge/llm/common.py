"""Helpers shared by the text operators: Arrow column access, shared storage, heavy-key joins."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.plans.storage import shared_dir

#: Bytes to bytes: A-Z lowered, every ASCII byte that is not a letter or digit becomes a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def folded_words(text: str) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters, as UTF-8."""
    return text.encode().translate(FOLD).split()


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A string column as Python strings, null as the empty string."""
    return [x if x is not None else "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few of them are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def chunks(texts: list[str], size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Start and end of runs of texts of about ``size`` characters; a longer text is a run of its own."""
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) <= size):
            total += len(texts[end])
            end += 1
        yield at, end
        at = end


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, object]], schema: str) -> DataFrame:
    """Apply ``fn`` (batch to columns) to small Arrow batches of ``df``; nothing but one is held."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = fn(batch)
            yield pa.RecordBatch.from_arrays([x if isinstance(x := out[n], pa.Array) else pa.array(x, ARROW[k]) for n, k in zip(names, kinds, strict=True)], names)

    kinds = [f.split()[1] for f in schema.split(", ")]
    return df.mapInArrow(run, schema)


ARROW = {
    "string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
}


def saved(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage is cut, and it survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/t-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def drop_saved(*frames: DataFrame) -> None:
    """Delete tables of :func:`saved` once nothing reads them any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.saved_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its 0-based place in ``order``; rows that tie in all of it must be equal, or their places may be dealt either way. Saved.

    One range sort, written to the shared folder with each row's place in its partition; the counts of partitions (a row each) are
    summed and broadcast.
    """
    rows = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, before, total = F.shiftright("__at", 33), [], 0
    for p, n in sorted((r[0], r[1]) for r in rows.groupBy(part.alias("p")).agg(F.count("*")).collect()):
        before.append((p, total))
        total += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "__p long, __before long"))
    out = rows.withColumn("__p", part).join(offsets, "__p")
    out = out.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__p", "__before", "__at")
    out.saved_path = rows.saved_path
    return out


def join_heavy(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, how: str = "inner", parts: int = 200) -> DataFrame:
    """``left`` join ``right`` on ``key`` (unique in ``right``) where few keys may hold most rows of ``left``.

    ``counts`` holds (key, n). Keys with over 1/parts of all rows number below ``parts``; their right
    rows are broadcast, a proven bound, and the rest is a plain shuffled join. Rows of a few bytes allow more parts than whole
    sets of shingles.
    """
    top = counts.where("n > 100").orderBy(F.col("n").desc()).limit(parts).select(key, "n").collect()
    total = counts.agg(F.sum("n")).first()[0] if top else 0
    keys = [r[0] for r in top if r[1] > total // parts]
    if not keys:
        return left.join(right, key, how)
    hot = F.col(key).isin(keys)
    return left.where(hot).join(F.broadcast(right.where(hot)), key, how).unionByName(left.where(~F.coalesce(hot, F.lit(False))).join(right.where(~hot), key, how))
