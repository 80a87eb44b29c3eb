"""The user's objects: ``Ranges`` (one interval per row) and ``RangesList`` (one group per row).

Both are thin values around a lazy DataFrame; every method is a plan builder from ``operators``.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators import intra, lists, merge, nearest, order, overlaps, pairwise, tiling
from spanforge.plans.ordinals import with_ordinal
from spanforge.sources import io

ROLES = io.ROLES
INFO = "seqnames string, seqlength int, is_circular boolean, genome string"


def seqinfo_of(spark: SparkSession, df: DataFrame | None = None, lengths: dict[str, int | None] | None = None, circular: dict[str, bool] | None = None, genome: str | None = None) -> DataFrame:
    """One row per sequence; the sequences found in ``df``, sorted, if no lengths are given."""
    if lengths is None:
        found = df.select("seqnames").distinct()
        return found.select("seqnames", F.lit(None).cast("int").alias("seqlength"), F.lit(None).cast("boolean").alias("is_circular"), F.lit(genome).alias("genome"))
    return spark.createDataFrame([(n, v, (circular or {}).get(n), genome) for n, v in lengths.items()], INFO)


class WithSequences:
    """What both classes know of their sequences and dimension table."""

    def seqlevels(self) -> list[str]:
        return [r[0] for r in self.seqinfo.select("seqnames").orderBy("seqnames").collect()]

    def _known(self, column: str) -> dict:
        return {r[0]: r[1] for r in self.seqinfo.select("seqnames", column).orderBy("seqnames").collect()}

    def seqlengths(self) -> dict[str, int | None]:
        return self._known("seqlength")

    def is_circular(self) -> dict[str, bool | None]:
        return self._known("is_circular")

    def genome(self) -> dict[str, str | None]:
        return self._known("genome")

    def _set(self, column: str, values: dict, kind: str):
        rows = self.seqinfo.sparkSession.createDataFrame([(k, v) for k, v in values.items()], f"seqnames string, __new {kind}")
        new = self.seqinfo.join(rows.withColumn("__given", F.lit(True)), "seqnames", "left")
        return replace(self, seqinfo=new.withColumn(column, F.when(F.col("__given"), F.col("__new")).otherwise(F.col(column))).select(*self.seqinfo.columns))

    def with_seqlengths(self, lengths: dict[str, int | None]):
        """The given lengths; sequences that are not named keep theirs."""
        return self._set("seqlength", lengths, "int")

    def with_circular(self, circular: dict[str, bool | None]):
        return self._set("is_circular", circular, "boolean")

    def with_genome(self, genome: str | dict[str, str | None]):
        if isinstance(genome, dict):
            return self._set("genome", genome, "string")
        return replace(self, seqinfo=self.seqinfo.withColumn("genome", F.lit(genome)))

    def with_dims(self, dims: DataFrame | None):
        """Only rows whose key the dimension table has; None forgets the table and keeps the rows that are left."""
        if dims is None:
            return replace(self, dims=None)
        if self.key is None or self.key not in dims.columns:
            raise ValueError("a dimension table needs the key of the rows")
        return replace(self, df=self.df.join(dims, self.key, "left_semi"), dims=dims)

    def table(self, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
        """The rows as a DataFrame, of some columns, under a condition."""
        df = self.df if where is None else self.df.where(where)
        return df if columns is None else df.select(*columns)

    @property
    def session(self) -> SparkSession:
        return self.df.sparkSession

    def updated(self):
        """The object in its present form: as there is only one, itself."""
        return self

    def _preview(self, place: str, shown: int = 5) -> str:
        """The first and last rows and the sequences; as much as a row more than is shown decides whether there are more."""
        first = self.df.orderBy(place).limit(2 * shown + 1).collect()
        rows = [*first] if len(first) <= 2 * shown else [*first[:shown], "...", *reversed(self.df.orderBy(F.col(place).desc()).limit(shown).collect())]
        info = "" if self.seqinfo is None else f"\nsequences: {', '.join(f'{k} ({v})' if v is not None else k for k, v in list(self.seqlengths().items())[:20])}"
        return f"{type(self).__name__}[{', '.join(self.df.columns)}]\n" + "\n".join(map(str, rows)) + info


def chosen(df: DataFrame, at: list | slice, key: str | None, place: str) -> DataFrame:
    """Rows by a slice, by positions (1-based), by a list of truth values, or by names."""
    if isinstance(at, slice):
        return order.between(df, at.start, at.stop, at.step, place)
    at = list(at)
    if at and isinstance(at[0], bool):
        return order.pick(df, [k + 1 for k, x in enumerate(at) if x], place)
    if at and isinstance(at[0], str):
        if key is None:
            raise ValueError("rows without a key have no names")
        return order.pick_names(df, key, at, place)
    return order.pick(df, at, place)


@dataclass(frozen=True)
class Ranges(WithSequences):
    """rid (place), seqnames, start, end, strand and metadata columns of ``df``; ``key`` names the rows."""

    df: DataFrame
    seqinfo: DataFrame | None = None
    key: str | None = None
    dims: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, data: str | DataFrame, *, seqnames=None, start=None, end=None, width=None, strand=None, key: str | list | None = None, mcols: list[str] | None = None, order: list[str] | None = None, dims: DataFrame | None = None, lengths: dict | None = None, circular: dict | None = None, genome: str | None = None) -> Ranges:
        """Bind roles to a source. ``key`` is a column, or [column, values in the wanted order]; ``dims`` is a table keyed alike, joined for pruning."""
        raw = io.source(spark, data)
        values = None
        if isinstance(key, (list, tuple)):
            key, values = key
            places = spark.createDataFrame([(v, k + 1) for k, v in enumerate(values)], [key, "rid"])
            raw = raw.drop("rid").join(places, key)
        if dims is not None:
            raw = raw.join(dims, key, "left_semi")
        if values is not None:
            lo, hi = io.third(start, end, width)
            df = raw.select("rid", io.role(seqnames, "").cast("string").alias("seqnames"), lo.cast("int").alias("start"), hi.cast("int").alias("end"), io.role(strand, "*").cast("string").alias("strand"), *dict.fromkeys([key, *(mcols or [])]))
        else:
            df = io.bind(raw, seqnames=seqnames, start=start, end=end, width=width, strand=strand, key=key, mcols=mcols, order=order)
        return cls(df, seqinfo_of(spark, df, lengths, circular, genome), key, dims)

    @classmethod
    def of(cls, df: DataFrame, seqinfo: DataFrame | None = None) -> Ranges:
        """A result without places gets those of its sorted order."""
        if "rid" not in df.columns:
            df = with_ordinal(df, [F.col(c) for c in ("seqnames", "strand", "start", "end")])
        return cls(df.select("rid", *ROLES, *[c for c in df.columns if c not in ("rid", *ROLES)]), seqinfo)

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: list[tuple], mcols: str = "", lengths: dict | None = None, names: list[str] | None = None, circular: dict | None = None, genome: str | None = None) -> Ranges:
        """Ranges in memory, as the other side of any join; ``names`` become the key ``name``."""
        if names is not None:
            rows, mcols = [(*r, n) for r, n in zip(rows, names, strict=True)], f"{mcols}, name string" if mcols else "name string"
        df = io.from_rows(spark, rows, mcols)
        return cls(df, seqinfo_of(spark, df, lengths, circular, genome), None if names is None else "name")

    def _with(self, df: DataFrame) -> Ranges:
        return replace(self, df=df)

    # Accessors
    seqnames = property(lambda self: self.df["seqnames"])
    start = property(lambda self: self.df["start"])
    end = property(lambda self: self.df["end"])
    strand = property(lambda self: self.df["strand"])
    width = property(lambda self: self.df["end"] - self.df["start"] + 1)

    def __getitem__(self, at: Column | str | list | slice) -> Ranges | Column:
        """A condition filters, a name is a metadata column; a slice, positions (1-based), truth values and names of rows pick rows in the order given, as often as given, which get new places."""
        if isinstance(at, str):
            return self.df[at]
        if isinstance(at, Column):
            return self._with(self.df.where(at))
        return self._with(chosen(self.df, at, self.key, "rid"))

    @property
    def mcols(self) -> DataFrame:
        return self.df.drop(*ROLES)

    def with_mcols(self, columns: dict[str, Column]) -> Ranges:
        return self._with(self.df.withColumns(columns))

    def ranges(self, mcols: bool = False) -> DataFrame:
        return self.df.select("rid", "start", "end", self.width.alias("width"), *([c for c in self.df.columns if c not in ("rid", *ROLES)] if mcols else []))

    def names(self) -> DataFrame:
        return self.df.select("rid", self.key if self.key else F.lit(None).cast("string").alias("name"))

    def __len__(self) -> int:
        return self.df.count()

    def has_row_number(self) -> bool:
        return self.key is None

    def to_pandas(self):
        return self.df.orderBy("rid").toPandas()

    def realize(self) -> Ranges:
        return self._with(self.df.persist())

    def write(self, path: str, partition_by: str | None = None) -> None:
        io.write(self.df, path, partition_by)

    def store(self, table: str, path: str | None = None, buckets: int = 200) -> None:
        """A table of the catalog laid out for overlap joins (:meth:`find_stored`)."""
        overlaps.store(self.df, table, path, buckets)

    @classmethod
    def stored(cls, spark: SparkSession, table: str, key: str | None = None) -> Ranges:
        df = overlaps.stored(spark, table).drop("sequence")
        return cls(df, seqinfo_of(spark, df), key)

    def find_stored(self, table: str, **options) -> DataFrame:
        """Pairs with a stored table, which is read where it lies: only this side is dealt out."""
        return overlaps.stored_pairs(self.df, table, **options)

    def __repr__(self) -> str:
        return self._preview("rid")

    # Each range alone
    def shift(self, by: int = 0) -> Ranges:
        return self._with(intra.shift(self.df, by))

    def narrow(self, start=None, end=None, width=None) -> Ranges:
        return self._with(intra.narrow(self.df, start, end, width))

    def resize(self, width: int, fix: str = "start", ignore_strand: bool = False) -> Ranges:
        return self._with(intra.resize(self.df, width, fix, ignore_strand))

    def flank(self, width: int, start: bool = True, both: bool = False, ignore_strand: bool = False) -> Ranges:
        return self._with(intra.flank(self.df, width, start, both, ignore_strand))

    def promoters(self, upstream: int = 2000, downstream: int = 200) -> Ranges:
        return self._with(intra.promoters(self.df, upstream, downstream))

    def terminators(self, upstream: int = 2000, downstream: int = 200) -> Ranges:
        return self._with(intra.terminators(self.df, upstream, downstream))

    def trim(self) -> Ranges:
        return self._with(intra.trim(self.df, self.seqinfo))

    def restrict(self, start=None, end=None, keep_all: bool = False) -> Ranges:
        return self._with(intra.restrict(self.df, start, end, keep_all))

    # Merging
    def _merged(self, df: DataFrame) -> Ranges:
        return Ranges.of(df, self.seqinfo)

    def range(self, ignore_strand: bool = False) -> Ranges:
        return self._merged(merge.span(self.df, ignore_strand))

    def reduce(self, **options) -> Ranges:
        return self._merged(merge.reduce(self.df, **options))

    def disjoin(self, **options) -> Ranges:
        return self._merged(merge.disjoin(self.df, **options))

    def gaps(self, **options) -> Ranges:
        return self._merged(merge.gaps(self.df, self.seqinfo, **options))

    def coverage(self, **options) -> DataFrame:
        return merge.coverage(self.df, self.seqinfo, **options)

    def _both_infos(self, other: Ranges) -> DataFrame | None:
        if self.seqinfo is None or other.seqinfo is None:
            return other.seqinfo if self.seqinfo is None else self.seqinfo
        return self.seqinfo.unionByName(other.seqinfo).groupBy("seqnames").agg(F.max("seqlength").alias("seqlength"), F.max("is_circular").alias("is_circular"), F.max("genome").alias("genome"))

    def union(self, other: Ranges, ignore_strand: bool = False) -> Ranges:
        return Ranges.of(merge.union(self.df, other.df, ignore_strand=ignore_strand), self._both_infos(other))

    def intersect(self, other: Ranges, ignore_strand: bool = False) -> Ranges:
        return Ranges.of(merge.intersect(self.df, other.df, ignore_strand), self._both_infos(other))

    def setdiff(self, other: Ranges, ignore_strand: bool = False) -> Ranges:
        return Ranges.of(merge.setdiff(self.df, other.df, ignore_strand), self._both_infos(other))

    def reduce_links(self, **options) -> DataFrame:
        """Which ranges each result of :meth:`reduce` was made from."""
        return merge.reduce_links(self.df, **options)

    def disjoin_links(self, **options) -> DataFrame:
        """Which ranges cover each result of :meth:`disjoin`."""
        return merge.disjoin_links(self.df, **options)

    # Joins
    def find_overlaps(self, subject: Ranges, **options) -> DataFrame:
        return overlaps.find_overlaps(self.df, subject.df, **options)

    def count_overlaps(self, subject: Ranges, **options) -> DataFrame:
        return overlaps.count_overlaps(self.df, subject.df, **options)

    def overlaps_any(self, subject: Ranges, **options) -> DataFrame:
        return overlaps.overlaps_any(self.df, subject.df, **options)

    def over(self, subject: Ranges, **options) -> DataFrame:
        """(query_idx, overlaps): which ranges lie over some range of ``subject``."""
        return self.overlaps_any(subject, **options)

    def subset_by_overlaps(self, subject: Ranges, invert: bool = False, **options) -> Ranges:
        return self._with(overlaps.subset_by_overlaps(self.df, subject.df, invert, **options))

    def match(self, table: Ranges, **options) -> DataFrame:
        return overlaps.match(self.df, table.df, **options)

    def precede(self, subject: Ranges | None = None, **options) -> DataFrame:
        return nearest.precede(self.df, None if subject is None else subject.df, **options)

    def follow(self, subject: Ranges | None = None, **options) -> DataFrame:
        return nearest.follow(self.df, None if subject is None else subject.df, **options)

    def nearest(self, subject: Ranges | None = None, **options) -> DataFrame:
        return nearest.nearest(self.df, None if subject is None else subject.df, **options)

    def distance_to_nearest(self, subject: Ranges | None = None, **options) -> DataFrame:
        return nearest.distance_to_nearest(self.df, None if subject is None else subject.df, **options)

    # Pairs
    def punion(self, y: Ranges, **options) -> Ranges:
        return self._with(pairwise.punion(self.df, y.df, **options))

    def pintersect(self, y: Ranges, **options) -> Ranges:
        return self._with(pairwise.pintersect(self.df, y.df, **options))

    def psetdiff(self, y: Ranges, **options) -> Ranges:
        return self._with(pairwise.psetdiff(self.df, y.df, **options))

    def pgap(self, y: Ranges, strict_key: bool = False, **options) -> Ranges:
        if strict_key and (self.key is None or y.key is None):
            raise ValueError("pgap with strict_key needs a key on both sides")
        return self._with(pairwise.pgap(self.df, y.df, **options))

    def distance(self, y: Ranges, **options) -> DataFrame:
        return pairwise.distance(self.df, y.df, **options)

    # Order
    def sort(self, decreasing: bool = False, ignore_strand: bool = False, level_order: list[str] | None = None) -> Ranges:
        placed = with_ordinal(order.leveled(self.df, level_order), order.sort_order(decreasing, ignore_strand, level_order), "__new")
        return self._with(placed.withColumn("rid", F.col("__new")).select(*self.df.columns))

    def order(self, **options) -> DataFrame:
        return order.order(self.df, **options)

    def rank(self, **options) -> DataFrame:
        return order.rank(self.df, **options)

    def is_unsorted(self, **options) -> bool:
        return order.is_unsorted(with_ordinal(self.df.withColumnRenamed("rid", "__was"), [F.col("__was")]), **options).first()[0]

    def duplicated(self, from_last: bool = False) -> DataFrame:
        return order.duplicated(self.df, from_last)

    def unique(self, from_last: bool = False) -> Ranges:
        return self._with(order.unique(self.df, from_last))

    def head(self, n: int = 6) -> Ranges:
        return self._with(order.head(self.df, n))

    def tail(self, n: int = 6) -> Ranges:
        return self._with(order.tail(self.df, n))

    # One to many
    def tile(self, n: int | None = None, width: int | None = None) -> DataFrame:
        return tiling.tile(self.df, n, width)

    def sliding_windows(self, width: int, step: int = 1) -> DataFrame:
        return tiling.sliding_windows(self.df, width, step)

    def split(self, by: str) -> RangesList:
        return RangesList(lists.split(self.df, by), by, self.seqinfo)


@dataclass(frozen=True)
class RangesList(WithSequences):
    """Groups of ranges: a key, four arrays, metadata per group; in the order of ``place``, a column, or else of the key."""

    df: DataFrame
    key: str
    seqinfo: DataFrame | None = field(default=None)
    dims: DataFrame | None = None
    place: str | None = None

    @classmethod
    def open(cls, spark: SparkSession, data: str | DataFrame, key: str | list, *, lengths: dict | None = None, circular: dict | None = None, genome: str | None = None, dims: DataFrame | None = None, **roles) -> RangesList:
        """``key`` is a column, or [column, values in the wanted order], which alone stay; ``dims`` is a table keyed alike, joined for pruning."""
        raw, values = io.source(spark, data), None
        if isinstance(key, (list, tuple)):
            key, values = key
        df = lists.bind_list(raw, key, **roles)
        out = cls(df, key, seqinfo_of(spark, df.select(F.explode("seqnames").alias("seqnames")), lengths, circular, genome))
        if values is not None:
            out = out[list(values)]
        return out if dims is None else out.with_dims(dims)

    # Accessors: a column of arrays each
    seqnames = property(lambda self: self.df["seqnames"])
    start = property(lambda self: self.df["start"])
    end = property(lambda self: self.df["end"])
    strand = property(lambda self: self.df["strand"])
    width = property(lambda self: F.zip_with(self.df["start"], self.df["end"], lambda s, e: e - s + 1))

    @property
    def _by(self) -> str:
        return self.place or self.key

    def _placed(self) -> RangesList:
        """With a column of places."""
        if self.place:
            return self
        return replace(self, df=with_ordinal(self.df, [F.col(self.key)], "place"), place="place")

    def element_nrows(self) -> DataFrame:
        return lists.element_nrows(self.df, self.key)

    def unlist(self) -> DataFrame:
        return lists.unlist(self.df, self.key)

    def names(self) -> DataFrame:
        return self.df.select(self.key)

    @property
    def mcols(self) -> DataFrame:
        """The key and the metadata of the groups."""
        return self.df.drop(*lists.ARRAYS, *([self.place] if self.place else []))

    def with_mcols(self, columns: dict[str, Column]) -> RangesList:
        if clash := set(columns) & {*lists.ARRAYS, self.key}:
            raise ValueError(f"not metadata: {sorted(clash)}")
        return replace(self, df=self.df.withColumns(columns))

    def __getitem__(self, at: object) -> DataFrame | RangesList:
        """One name gives the ranges of that group; a condition, a slice, positions, truth values or names of groups give groups."""
        if isinstance(at, Column):
            return self.where(at)
        if isinstance(at, (slice, list, tuple)):
            if at and not isinstance(at, slice) and not isinstance(at[0], (bool, int)) or isinstance(at, (list, tuple)) and not at:
                df = self.df if self.place else self.df.withColumn("place", F.lit(0).cast("long"))
                return replace(self, df=order.pick_names(df, self.key, list(at), self.place or "place"), place=self.place or "place")
            out = self._placed()
            return replace(out, df=chosen(out.df, at, self.key, out.place))
        return lists.get(self.df, self.key, at)

    def range(self, ignore_strand: bool = False) -> RangesList:
        return replace(self, df=lists.list_range(self.df, self.key, ignore_strand), place=None)

    def rename(self, names: DataFrame) -> RangesList:
        """Groups under new names, in the order they had."""
        out = self._placed()
        return replace(out, df=lists.rename(out.df, self.key, names))

    def take(self, positions: list[int]) -> RangesList:
        """Groups at 1-based positions, in the order given and as often as given."""
        return self[list(positions)] if positions else self.head(0)

    def where(self, condition: Column) -> RangesList:
        return replace(self, df=self.df.where(condition))

    def head(self, n: int = 6) -> RangesList:
        return replace(self, df=order.head(self.df, n, self._by))

    def tail(self, n: int = 6) -> RangesList:
        return replace(self, df=order.tail(self.df, n, self._by))

    def realize(self) -> RangesList:
        return replace(self, df=self.df.persist())

    def __len__(self) -> int:
        return self.df.count()

    def __repr__(self) -> str:
        return self._preview(self._by)

    def to_pandas(self):
        return self.unlist().toPandas()
