"""Near duplicates by ProbMinHash, banding and exact verification.

Each distinct shingle of a document (five folded words; a shorter text is one shingle) is an element
of weight one. Its arrivals form a Poisson process with that rate; every arrival picks a
register, and a register keeps the element that arrives first. An element stops as soon as its next
arrival is later than the latest register of its document. Two documents agree in a register with
the probability Jaccard of their weighted shingles: with equal weights the Jaccard of the distinct shingles,
however often a passage repeats. Bands of registers propose pairs, and the same Jaccard, exact, decides.

No bucket is turned into all of its pairs. First each bucket's members are compared with one leader, the
member with most bucket mates over all bands: the middle of a family of copies. That gives classes. Texts
that still share a bucket with another class are then joined exactly across classes by prefix filtering: two
sets with Jaccard t must share one of the few rarest shingles of each. In a family these are
each text's own edits, so texts that are merely of the same family do not meet. So no pair that
shares a bucket is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import FOLD, chunks, drop_saved, join_heavy, saved, slices, strings

SHINGLE, ROWS, BANDS = 5, 6, 32
REGISTERS = ROWS * BANDS
#: Fixed odd multipliers of the hashes.
PRIME, STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
MASK = (1 << 64) - 1
PLACES = np.array([pow(0xBF58476D1CE4E5B9, k + 1, 1 << 64) for k in range(SHINGLE)], np.uint64)

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters its input."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of PRIME and of its inverse modulo 2^64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = n + n // 4
            tables = []
            for base in (PRIME, pow(PRIME, -1, 1 << 64)):
                t = np.full(size, base, np.uint64)
                t[0] = 1
                tables.append(np.cumprod(t, dtype=np.uint64))
            self.up, self.down = tables
        return self.up[:n], self.down[:n]


POWERS = Powers()


def shingles(folded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of every shingle of some folded texts, in order of owners."""
    data = np.frombuffer(b" ".join(folded) + b" ", np.uint8)
    lengths = np.fromiter(map(len, folded), np.int64, len(folded)) + 1
    ends_of_text = np.cumsum(lengths)
    up, down = POWERS.get(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
    gap = np.concatenate([[True], data == 32])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    words = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    owner = np.searchsorted(ends_of_text, starts, side="right")
    n = len(words) - SHINGLE + 1
    whole = np.zeros(0, np.uint64)
    own = np.zeros(0, np.int64)
    if n > 0:
        whole = sum((words[k : n + k] * PLACES[k] for k in range(1, SHINGLE)), words[:n] * PLACES[0])
        keep = owner[:n] == owner[SHINGLE - 1 :]
        whole, own = whole[keep], owner[:n][keep]
    counts = np.bincount(owner, minlength=len(folded))
    for k in np.flatnonzero((counts > 0) & (counts < SHINGLE)).tolist():
        at = np.searchsorted(owner, k)
        one = np.uint64(counts[k]) + (words[at : at + counts[k]] * PLACES[: counts[k]]).sum(dtype=np.uint64)
        whole, own = np.append(whole, one), np.append(own, k)
    return own, mix(whole)


def distinct(owner: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, hash and count of each distinct shingle, sorted by both."""
    order = np.lexsort((shingle, owner))
    o, s = owner[order], shingle[order]
    first = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (s[1:] != s[:-1])])) if len(o) else np.zeros(0, np.int64)
    return o[first], s[first], np.diff(np.append(first, len(o)))


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """The n x m registers; rows of owners without shingles stay zero."""
    time, held = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    at, k = np.zeros(len(owner)), 0
    while len(owner):
        k += 1
        r = mix(shingle + np.uint64(k * STEP & MASK))
        at = at - np.log(((r >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight
        slot = owner * m + (mix(r ^ np.uint64(PRIME)) % np.uint64(m)).astype(np.int64)
        won = at < time[slot]
        np.minimum.at(time, slot[won], at[won])
        last = won & (at == time[slot])
        held[slot[last]] = shingle[last]
        live = at < time.reshape(n, m).max(1)[owner]
        owner, shingle, weight, at = owner[live], shingle[live], weight[live], at[live]
    return held.reshape(n, m)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    x = registers.reshape(len(registers), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), x.shape[:2]) * np.uint64(STEP)
    for k in range(ROWS):
        key = mix(key * np.uint64(PRIME) + x[:, :, k])
    return key.view(np.int64)


def digest(folded: bytes) -> bytes:
    """Names the words of a folded text."""
    return xxhash.xxh3_128_digest(b" ".join(folded.split()))


#: Bits of a filter: so many for each digest, and at most so many in all (16 MB).
FILTER_BITS, FILTER_MOST = 12, 1 << 27


def places(one: np.ndarray, two: np.ndarray, bits: int) -> np.ndarray:
    """Three bits of a filter for each pair of 64-bit hashes."""
    return np.stack([(one + np.uint64(k) * two) % np.uint64(bits) for k in range(3)], 1).astype(np.int64)


def digest_places(digests: list[bytes], bits: int) -> np.ndarray:
    x = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return places(x[:, 0], x[:, 1], bits)


def band_places(bands: np.ndarray, bits: int) -> np.ndarray:
    x = bands.astype(np.int64).view(np.uint64)
    return places(mix(x), mix(x ^ np.uint64(PRIME)), bits)


def there(mask: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Whether all bits of each row are set in a filter."""
    return ((mask[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1).all(1)


def bloom(wanted: DataFrame) -> np.ndarray:
    """A Bloom filter of the first column (digests or bands) of ``wanted``, of bounded size; beyond it more rows pass, and joins drop them."""
    n = wanted.count()
    bits = min(FILTER_MOST, max(1 << 16, 1 << (FILTER_BITS * n).bit_length()))

    def run(batches):
        for b in slices(batches, 100_000):
            x = b.column(0)
            at = np.unique(digest_places(x.to_pylist(), bits) if pa.types.is_binary(x.type) else band_places(x.to_numpy(), bits))
            word, first = np.unique(at >> 5, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.bitwise_or.reduceat(np.left_shift(1, at & 31), first))], ["word", "mask"])

    out = np.zeros(bits >> 5, np.int64)
    rows = wanted.mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out[rows["word"].to_numpy()] = rows["mask"].to_numpy()
    return out.astype(np.uint32)


def in_bands(sketch: DataFrame, bands: DataFrame) -> DataFrame:
    """(band, digest, n) of the rows of ``sketch`` whose band may be one of ``bands``, by a filter."""
    shared = sketch.sparkSession.sparkContext.broadcast(bloom(bands.select("band")))

    def run(batches):
        for b in slices(batches):
            x = b.column(0)
            keys = x.flatten().to_numpy()
            hit = np.flatnonzero(there(shared.value, band_places(keys, len(shared.value) << 5)))
            row = pa.array(hit // BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys[hit]), b.column(1).take(row), b.column(2).take(row)], ["band", "digest", "n"])

    return sketch.where("bands is not null").select("bands", "digest", "n").mapInArrow(run, "band long, digest binary, n long")


def shingle_sets(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(digest, shingles) of each wanted digest: its sorted distinct shingles as bytes.

    Texts are read again, but only those that pass a filter of the wanted digests are shingled and shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bloom(wanted))

    def run(batches):
        seen: set[bytes] = set()
        mask = shared.value
        for b in slices(batches):
            texts = strings(b, "text")
            for at, end in chunks(texts):
                folded = [x.encode().translate(FOLD) for x in texts[at:end]]
                digests = [digest(x) for x in folded]
                new = [k for k in np.flatnonzero(there(mask, digest_places(digests, len(mask) << 5))).tolist() if digests[k] not in seen and not seen.add(digests[k])]
                if new:
                    o, s, _ = distinct(*shingles([folded[k] for k in new]))
                    cuts = np.searchsorted(o, np.arange(len(new) + 1))
                    yield pa.RecordBatch.from_arrays([pa.array([digests[k] for k in new], pa.binary()), pa.array([s[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["digest", "shingles"])

    sets = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "digest binary, shingles binary")
    # Tasks that saw the same digest each sent it; the rows of a digest are equal.
    return sets.join(wanted, "digest", "left_semi").dropDuplicates(["digest"])


def raw_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, hash of the text as it stands, digest of the folded text; on the first row of a digest in a task also its size and bands."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        seen: set[bytes] = set()
        for b in slices(batches):
            texts = strings(b, "text")
            for at, end in chunks(texts):
                folded = [x.encode().translate(FOLD) for x in texts[at:end]]
                digests = [digest(x) for x in folded]
                new = [k for k, d in enumerate(digests) if d not in seen and not seen.add(d)]
                n, bands = [None] * len(folded), [None] * len(folded)
                if new:
                    o, s, _ = distinct(*shingles([folded[k] for k in new]))
                    keys, sizes = band_keys(signatures(o, s, np.ones(len(o)), len(new))), np.bincount(o, minlength=len(new)).tolist()
                    for j, k in enumerate(new):
                        n[k], bands[k] = sizes[j], keys[j] if sizes[j] else None
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), b.column(2).slice(at, end - at), pa.array(digests, pa.binary()), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["id", "raw", "digest", "n", "bands"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), raw_hash(text_col).alias("raw")).mapInArrow(run, f"id {kind}, raw long, digest binary, n long, bands array<long>")


def jaccard(both: DataFrame) -> DataFrame:
    """(a, b, j): the exact Jaccard of the shingle sets sa and sb of each pair."""
    def run(batches):
        for batch in slices(batches):
            out = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, large = (x, y) if len(x) < len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int((large[at] == small).sum())
                out.append(common / (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["a", "b", "j"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary, j double")


def links_of(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) of distinct ``pairs`` whose exact Jaccard reaches the threshold; a may be in most pairs."""
    counts = pairs.groupBy(F.col("a").alias("digest")).agg(F.count("*").alias("n"))
    left = join_heavy(pairs.withColumnRenamed("a", "digest"), sets, "digest", counts).select(F.col("digest").alias("a"), F.col("shingles").alias("sa"), "b")
    both = left.join(sets.select(F.col("digest").alias("b"), F.col("shingles").alias("sb")), "b")
    return jaccard(both).where(F.col("j") >= threshold - 1e-12).select("a", "b")


#: Keys that may be broadcast where the rows joined to them are a few numbers.
SMALL = 1000
#: Cells of the table of shingle counts: a fixed size, whatever the corpus.
CELLS = 1 << 20


def cell_counts(sets: DataFrame) -> np.ndarray:
    """How often shingles of each cell (their low bits) occur in ``sets``."""
    def run(batches):
        total = np.zeros(CELLS, np.int64)
        for b in slices(batches):
            for x in b.column(0).to_pylist():
                np.add.at(total, (np.frombuffer(x, np.uint64) & np.uint64(CELLS - 1)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["cell", "n"])

    rows = sets.select("shingles").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.int64)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out


def open_pairs(rest: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Distinct (a, b) of ``rest`` (digest, n, root) with other roots that can reach the threshold, by prefix filtering.

    Shingles are ordered by the count of their cell, then by value. Sets of sizes m and n with Jaccard t have
    o = t / (1 + t) * (m + n) shingles in common, so the first common one stands among the first m - o + 1
    and n - o + 1.
    """
    shared = rest.sparkSession.sparkContext.broadcast(cell_counts(sets))

    def run(batches):
        for b in slices(batches):
            parts = []
            for x in b.column(3).to_pylist():
                x = np.frombuffer(x, np.uint64)
                order = np.lexsort((x, shared.value[(x & np.uint64(CELLS - 1)).astype(np.int64)]))
                parts.append(x[order[: len(x) - int(np.ceil(threshold * len(x) - 1e-9)) + 1]].view(np.int64))
            sizes = [len(x) for x in parts]
            at = pa.array(np.repeat(np.arange(b.num_rows), sizes))
            place = np.concatenate([np.arange(1, n + 1) for n in sizes])
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(3)), pa.array(np.concatenate(parts)), pa.array(place)], ["digest", "n", "root", "s", "place"])

    prefix = saved(rest.join(sets, "digest").select("digest", "n", "root", "shingles").mapInArrow(run, "digest binary, n long, root binary, s long, place long"))
    # Of a shingle's classes the largest is never joined with itself, so a family of any size costs no pairs.
    per = prefix.groupBy("s", "root").agg(F.count("*").alias("c"))
    top = saved(per.groupBy("s").agg(F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("roots"), F.sum("c").alias("n")).where("roots > 1"))
    marked = saved(join_heavy(prefix, top.select("s", F.col("top.root").alias("largest")), "s", top))
    x, y = (marked.select("s", F.col("digest").alias(a), F.col("n").alias(f"n{a}"), F.col("root").alias(f"r{a}"), F.col("place").alias(f"p{a}"), (F.col("root") == F.col("largest")).alias(f"t{a}")) for a in "ab")
    common = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-9)
    near = (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb")) & (F.col("pa") <= F.col("na") - common + 1) & (F.col("pb") <= F.col("nb") - common + 1)
    pairs = x.where(~F.col("ta")).join(y, "s").where((F.col("ra") != F.col("rb")) & (F.col("tb") | (F.col("a") < F.col("b"))) & near)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): the least node of its component.

    Alternates large stars and small stars until nothing changes; each round is one aggregation over the
    edges, which shrink to one star per component.
    """
    edges = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    # Number and sum of hashes of the edges tell whether a round changed them.
    print_ = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")).withColumn("low", F.least("low", "a"))
        large = join_heavy(both, least.select("a", "low"), "a", least.select("a", "n")).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").unionByName(least.withColumnRenamed("low", "b")).distinct()
        old, edges = edges, saved(small)
        drop_saved(old)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == print_:
            break
        print_ = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def grouped(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(id, raw, root) of every row, saved: the hash of its text, and the digest that leads its class."""
    sketch = saved(sketches(docs, id_col, text_col))
    buckets = sketch.where("bands is not null").select(F.explode("bands").alias("band"), "digest", "n")
    counts = saved(buckets.groupBy("band").agg(F.count("*").alias("n"), F.min("digest").alias("a"), F.max("digest").alias("z")).where("a <> z").select("band", "n"))
    # Copies that several tasks saw are the same member.
    members = saved(join_heavy(in_bands(sketch, counts), counts.withColumnRenamed("n", "mates"), "band", counts, parts=SMALL).distinct())
    score = members.groupBy("digest").agg(F.sum("mates").alias("score"))
    best = members.join(score, "digest").groupBy("band").agg(F.max(F.struct("score", "digest", "n")).alias("l")).select("band", F.col("l.digest").alias("a"), F.col("l.n").alias("na"))
    asked = join_heavy(members, best, "band", counts, parts=SMALL).where("a <> digest").where(F.least("na", "n") >= threshold * F.greatest("na", "n"))
    pairs = saved(asked.select("a", F.col("digest").alias("b")).distinct())
    wanted = saved(members.select("digest").distinct())
    sets = saved(shingle_sets(docs, text_col, wanted))
    links = saved(links_of(pairs, sets, threshold))
    roots = saved(components(links))
    classed = members.select("band", "digest", "n").join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    mixed = classed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high")
    rest = saved(join_heavy(classed, mixed.select("band"), "band", mixed.select("band", "n"), "left_semi", SMALL).select("digest", "n", "root").distinct())
    drop_saved(pairs, roots)
    left = saved(open_pairs(rest, sets, threshold))
    more = saved(links_of(left, sets, threshold))
    drop_saved(counts, members, wanted, sets, rest, left)
    roots = saved(components(links.unionByName(more)))
    rows = sketch.select("id", "raw", "digest")
    counts = rows.groupBy("digest").agg(F.count("*").alias("n"))
    placed = join_heavy(rows, roots.withColumnRenamed("node", "digest"), "digest", counts, "left").withColumn("root", F.coalesce("root", "digest"))
    placed = saved(placed.select("id", "raw", "root"))
    drop_saved(sketch, links, more, roots)
    return placed


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row per input row: id, class_id (least id of its class), class_size.

    Texts that fold to the same words are copies; null, empty and wordless texts are copies of one another.
    Rows with the same id are rows of their own; a class without any id has a null class_id; other
    columns are ignored; a very long text is shingled whole; an empty table gives an empty result. Everything after the sketches works on
    digests of distinct texts.
    """
    placed = grouped(docs, id_col, text_col, threshold)
    per = placed.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("n"))
    return join_heavy(placed, per.select("root", "class_id", F.col("n").alias("class_size")), "root", per.select("root", "n")).select(F.col("id").alias(id_col), "class_id", "class_size")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each class, all columns as they are: of its rows with the least id (rows without an id come last) that of the least hash of its text.

    Rows are told apart by id and text, so of rows with one id and different texts each stands for its own class; a class of rows
    without ids keeps one of them. Null, empty and wordless texts are copies of one another, very long ones are shingled whole, an empty table gives an empty one.
    """
    placed = grouped(docs, id_col, text_col, threshold)
    best = placed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "raw")).alias("b")).select(F.col("b.id").alias("kept_id"), F.col("b.raw").alias("kept_raw"))
    # How often the very row stands in the table: where more than once, one of them stays.
    times = placed.groupBy(F.col("id").alias("i"), F.col("raw").alias("r")).agg(F.count("*").alias("times")).where("times > 1")
    reps = saved(best.join(times, best["kept_id"].eqNullSafe(times["i"]) & (best["kept_raw"] == times["r"]), "left").select("kept_id", "kept_raw", F.col("times").isNotNull().alias("again")))
    # The row is one column, so that no name of it can clash.
    rows = docs.select(F.col(id_col).alias("id"), raw_hash(text_col).alias("raw"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    stay = lambda which: rows.join(reps.where(which), F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("raw") == F.col("kept_raw")), "left_semi")
    out = stay("not again")
    if not reps.where("again").isEmpty():
        out = out.unionByName(stay("again").dropDuplicates(["id", "raw"]))
    return out.select("row.*")
