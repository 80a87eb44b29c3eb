"""Repeated passages across documents by the Burrows-Wheeler transform of a collection, built column by column.

A byte goes if a string of WINDOW bytes over it also starts in a document with a smaller id. Sorting all suffixes of a
corpus of long documents one column at a time would take as many rounds as the longest has bytes. But only the first WINDOW
bytes of a suffix matter, so documents are cut into short ones first: every window belongs to the k-mer of least hash in it, its anchor,
and neighbouring windows of one anchor form a piece of at most WINDOW - 1 + SPREAD bytes. Equal windows have equal anchors, so
the pieces of one anchor meet in one bucket, and an anchor that a single document holds needs no search at all.

A bucket is a collection of short strings. Its transform starts with the empty suffix of every string; each round inserts one more symbol
of every string, the one before its last suffix, at the place that counts of symbols give (the last-to-first mapping), and updates the common prefixes at
and behind the new suffixes with range minima. Transform and prefixes go from round to round through sequential files. After the last
round, suffixes with a common prefix of WINDOW bytes are neighbours: the least id among them is the first document of that window.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import drop_saved, saved, slices

WINDOW, ANCHOR = 50, 24
#: Anchors that a window may have, and so the most windows of a piece.
SPREAD = WINDOW - ANCHOR + 1
#: Bytes of text whose anchors are hashed at a time; bytes of text a bucket of anchors stands for.
SEGMENT, BUCKET = 1 << 20, 1 << 25
#: Buckets at least; symbols of a collection, about; symbols of one anchor beyond which its pieces are cut again by other anchors.
LEAST_BUCKETS, COLLECTION, LIMIT = 256, 1 << 19, 1 << 20
#: Bytes of pieces that are sorted and dealt to buckets at a time; mark of a spot whose anchor may be over the limit, beside at most SPREAD windows.
BLOCK, CROWDED = 1 << 24, 1 << 5
#: Bytes of a transform that stay in memory between two rounds; beyond, its files are on disk.
HELD = 1 << 26
NOBODY = np.iinfo(np.int64).max
M = np.uint64
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def anchors(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """The anchor of the window at each place of ``data`` that has one: the least hash of its k-mers; ``seed`` gives another order of k-mers."""
    p, power, n = pow(MULTIPLIERS[0], 1 + 2 * seed, 1 << 64), data.astype(M), 1
    # Hashes of lengths of powers of two, put together to that of a k-mer.
    h, size = (power, 1) if ANCHOR & 1 else (np.zeros(len(data) + 1, M), 0)
    while 2 * n <= ANCHOR:
        power = power[:-n] * M(pow(p, n, 1 << 64)) + power[n:]
        n *= 2
        if ANCHOR & n:
            h = h[: len(power) - size] * M(pow(p, n, 1 << 64)) + power[size:]
            size += n
    h = h * M(MULTIPLIERS[1])
    h ^= h >> M(32)
    h *= M(MULTIPLIERS[2])
    h ^= h >> M(29)
    n = 1
    while 2 * n <= SPREAD:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return np.minimum(h[: len(h) - (SPREAD - n)], h[SPREAD - n :]) if n < SPREAD else h


def pieces(data: np.ndarray, ends: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, windows, anchor) of every piece of texts that stand one behind the other in ``data`` up to ``ends``."""
    out = []
    lead = np.maximum(np.concatenate([[0], ends[:-1]]), ends - (WINDOW - 1))
    for at in range(0, max(len(data) - WINDOW + 1, 0), SEGMENT):
        part = data[at : at + SEGMENT + WINDOW - 1]
        h = anchors(part, seed)
        # No window reaches over the end of a text: the last places of each begin none.
        inside = np.zeros(len(h) + 1, np.int32)
        a, z = np.searchsorted(ends, at, "right"), np.searchsorted(lead, at + len(h), "left")
        np.add.at(inside, np.clip(lead[a:z] - at, 0, len(h)), 1)
        np.add.at(inside, np.clip(ends[a:z] - at, 0, len(h)), -1)
        good = np.cumsum(inside[:-1]) == 0
        head = good.copy()
        head[1:] &= (h[1:] != h[:-1]) | ~good[:-1]
        edge = np.flatnonzero(head | ~good)
        size = np.diff(np.append(edge, len(h)))
        keep = good[edge]
        edge, size = edge[keep], size[keep]
        if len(size) and size.max() > SPREAD:
            # Only where k-mers repeat inside a piece.
            times = -(-size // SPREAD)
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            edge, left = np.repeat(edge, times) + step * SPREAD, np.repeat(size, times) - step * SPREAD
            size = np.minimum(left, SPREAD)
        out.append((edge + at, size, h[edge]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, M)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def bucket_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each anchor. Anchors are least hashes, small ones are frequent; a product spreads them evenly."""
    return ((anchor.view(M) * M(MULTIPLIERS[3]) >> M(32)) * M(buckets) >> M(32)).astype(np.int64)


def joined(values: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one behind the other, and where each ends."""
    values = [v or b"" for v in values]
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum(np.fromiter(map(len, values), np.int64, len(values)))


class Minima:
    """Least values of stretches of ``x``: tables of powers of two up to 64, and of blocks of 64 beyond."""

    def __init__(self, x: np.ndarray):
        self.size = len(x)
        self.low = np.zeros((7, len(x)), np.uint8)
        self.low[0] = x
        for k in range(1, 7):
            n = 1 << (k - 1)
            if len(x) > n:
                np.minimum(self.low[k - 1, :-n], self.low[k - 1, n:], out=self.low[k, :-n])
        self.blocks = [self.low[6, 0 : max(len(x) - 63, 0) : 64]]
        while len(self.blocks[-1]) > 1 << (len(self.blocks) - 1):
            n = 1 << (len(self.blocks) - 1)
            self.blocks.append(np.minimum(self.blocks[-1][:-n], self.blocks[-1][n:]))

    #: The power of two in a length below 128.
    POWER = np.array([0, *(n.bit_length() - 1 for n in range(1, 128))], np.int64)

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        n = last - first + 1
        k = self.POWER[np.minimum(n, 127)]
        flat = self.low.ravel()
        out = np.minimum(flat[k * self.size + first], flat[k * self.size + last + 1 - (1 << k)])
        far = np.flatnonzero(n >= 128)
        if len(far):
            a, z = (first[far] + 63) >> 6, ((last[far] + 1) >> 6) - 1
            level = np.frexp((z - a + 1).astype(float))[1] - 1
            best = out[far]
            for v in np.unique(level).tolist():
                at = np.flatnonzero(level == v)
                row = self.blocks[v]
                best[at] = np.minimum(best[at], np.minimum(row[a[at]], row[z[at] + 1 - (1 << v)]))
            out[far] = best
        return out


class Stream:
    """A sequence of bytes that is written whole and read whole, one round after the other."""

    def __init__(self, x: np.ndarray):
        self.file = tempfile.SpooledTemporaryFile(HELD)  # noqa: SIM115
        self.put(x)

    def put(self, x: np.ndarray) -> None:
        self.file.seek(0)
        self.file.truncate()
        self.file.write(x.tobytes())

    def get(self) -> np.ndarray:
        self.file.seek(0)
        return np.frombuffer(self.file.read(), np.uint8)


def transform(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the collection of strings in ``data``: Burrows-Wheeler transform (byte + 1, 0 where a string is whole), common prefixes, and the last-to-first
    mapping as the rows in order of their symbols. Ends of strings sort in the order of strings.
    """
    m = len(ends)
    length = np.diff(np.concatenate([[0], ends]))
    column = lambda j, r: np.where(j < length[r], data[np.maximum(ends[r] - 1 - j, 0)] + np.uint8(1), np.uint8(0))
    first = column(0, np.arange(m))
    bwt, prefix = Stream(first), Stream(np.zeros(m, np.uint8))
    # Rows whose string goes on, by symbol and row; where in this order the rows of the last round stand, and their strings.
    active = np.flatnonzero(first)
    active = active[np.argsort(first[active], kind="stable")]
    order, new, count = active.copy(), np.arange(len(active)), np.bincount(first, minlength=257)
    count[0] = 0
    for j in range(int(length.max(initial=0))):
        symbols, common = bwt.get(), prefix.get()
        # Prefixes at the new suffixes and behind them: one more than the least between their tails, where they begin alike.
        near = np.zeros(len(order) + 1, bool)
        near[new] = near[new + 1] = True
        near[0] = near[-1] = False
        at = np.flatnonzero(near)
        a, z = order[at - 1], order[at]
        same = symbols[a] == symbols[z]
        value = np.zeros(len(at), np.uint8)
        value[same] = Minima(common).of(a[same] + 1, z[same]) + 1
        place = m + new
        old = np.ones(m + len(order), bool)
        old[place] = False
        symbols_next, common_next = np.empty(len(old), np.uint8), np.zeros(len(old), np.uint8)
        symbols_next[old], common_next[old] = symbols, common
        fresh = symbols_next[place] = column(j + 1, active)
        common_next[m + at] = value
        bwt.put(symbols_next)
        prefix.put(common_next)
        # Rows move down by what was put in above them; the new ones join the rows of their symbol.
        order = np.flatnonzero(old)[order]
        by = np.flatnonzero(fresh)
        by = by[np.argsort(fresh[by], kind="stable")]
        row, edge = place[by], np.cumsum(count) - count
        here = np.bincount(fresh[by], minlength=257)
        spot, done = np.empty(len(by), np.int64), 0
        for c in np.flatnonzero(here).tolist():
            spot[done : done + here[c]] = edge[c] + np.searchsorted(order[edge[c] : edge[c] + count[c]], row[done : done + here[c]])
            done += here[c]
        new, active, count = spot + np.arange(len(by)), active[by], count + here
        kept = np.ones(len(order) + len(by), bool)
        kept[new] = False
        grown = np.empty(len(kept), np.int64)
        grown[kept], grown[new] = order, row
        order = grown
    return bwt.get(), prefix.get(), order


def first_seen(data: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For every window of every string, in order, the least id of a string of the collection that holds it."""
    symbols, common, order = transform(data, ends)
    m, length = len(ends), np.diff(np.concatenate([[0], ends]))
    to = np.empty(len(symbols), np.int64)
    to[order] = m + np.arange(len(order))
    heads = np.flatnonzero(common < WINDOW)
    # Suffixes of each string from the empty one on, by the last-to-first mapping.
    owner, where, who, steps = np.full(len(symbols), NOBODY), np.arange(m), np.arange(m), []
    shortest = int(length.min(initial=0))
    for j in range(1, int(length.max(initial=0)) + 1):
        if j > shortest:
            going = length[who] >= j
            who, where = who[going], where[going]
        where = to[where]
        if j >= WINDOW:
            owner[where] = ids[who]
            steps.append((who, length[who] - j, where))
    least = np.repeat(np.minimum.reduceat(owner, heads), np.diff(np.append(heads, len(symbols))))
    windows = length - WINDOW + 1
    start = np.cumsum(windows) - windows
    out = np.empty(windows.sum(), np.int64)
    for who, offset, where in steps:
        out[start[who] + offset] = least[where]
    return out


def packed(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of each stretch of ``x`` up to ``cuts`` as one binary value."""
    raw = x.tobytes()
    return pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(np.concatenate([[0], cuts * x.itemsize]).astype(np.int64).tobytes()), pa.py_buffer(raw)]).cast(pa.binary())


def dealt(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, anchor, key, spot): the pieces of ``docs`` (key, text), each column packed, as many rows as a batch has buckets."""
    def run(batches):
        for b in slices(batches, 2500):
            data, ends = joined(b.column(1).to_pylist())
            place, size, anchor = pieces(data, ends)
            doc = np.searchsorted(ends, place, "right")
            spot = ((place - np.concatenate([[0], ends[:-1]])[doc]) << 6) | size
            bucket = bucket_of(anchor, buckets)
            order = np.argsort(bucket, kind="stable")
            kind, count = np.unique(bucket, return_counts=True)
            cuts = np.cumsum(count)
            key = b.column(0).to_numpy()[doc]
            yield pa.RecordBatch.from_arrays([pa.array(kind), *(packed(x[order], cuts) for x in (anchor, key, spot))], ["bucket", "anchor", "key", "spot"])

    return docs.mapInArrow(run, "bucket long, anchor binary, key binary, spot binary")


def shared(dealt_out: DataFrame, limit: int) -> DataFrame:
    """(key, spots, anchors): the pieces of each key whose anchor another key has too; a row for each key of a bucket. Spots of anchors that may
    have over ``limit`` symbols are marked by CROWDED.
    """
    def run(batches):
        held: list[list[bytes]] = [[], [], []]
        now = None

        def close():
            anchor, key, spot = (np.frombuffer(b"".join(x), np.int64) for x in held)
            order = np.lexsort((key, anchor))
            a, k = anchor[order], key[order]
            head = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            several, many = k[head] != k[np.append(head[1:], len(a)) - 1], np.diff(np.append(head, len(a)))
            spot = spot.copy()
            spot[order[np.repeat(many * (WINDOW + SPREAD - 1) > limit, many)]] |= CROWDED
            at = order[np.repeat(several, many)]
            at = at[np.argsort(key[at], kind="stable")]
            owner, count = np.unique(key[at], return_counts=True)
            cuts = np.cumsum(count)
            return pa.RecordBatch.from_arrays([pa.array(owner), packed(spot[at], cuts), packed(anchor[at], cuts)], ["key", "spots", "anchors"])

        for b in slices(batches, 256):
            for bucket, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is not None and bucket != now:
                    yield close()
                    held = [[], [], []]
                now = bucket
                for x, y in zip(held, row, strict=True):
                    x.append(y)
        if now is not None:
            yield close()

    return dealt_out.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "key long, spots binary, anchors binary")


def contents(rows: DataFrame) -> DataFrame:
    """(anchor, piece, id, key, spot, crowded) of the shared pieces of rows (id, key, text, found)."""
    def run(batches):
        for b in slices(batches, 500):
            texts, found = b.column(2).to_pylist(), b.column(3).to_pylist()
            spots = [np.frombuffer(b"".join(x["spots"] for x in f), np.int64) for f in found]
            spot = np.concatenate(spots)
            place, crowded = spot >> 6, spot & CROWDED > 0
            size = (spot & (CROWDED - 1)) + WINDOW - 1
            which = np.repeat(np.arange(len(texts)), list(map(len, spots)))
            data, ends = joined(texts)
            start = np.concatenate([[0], ends[:-1]])[which] + place
            good = start + size <= ends[which]
            start, size, which = start[good], size[good], which[good]
            # Bytes of all pieces one behind the other.
            cuts = np.cumsum(size)
            flat = data[np.repeat(start - (cuts - size), size) + np.arange(cuts[-1] if len(cuts) else 0)]
            anchor = np.concatenate([np.frombuffer(b"".join(x["anchors"] for x in f), np.int64) for f in found])[good]
            at = pa.array(which)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), packed(flat, cuts), b.column(0).take(at), b.column(1).take(at), pa.array(place[good]), pa.array(crowded[good])], ["anchor", "piece", "id", "key", "spot", "crowded"])

    return rows.mapInArrow(run, "anchor long, piece binary, id long, key long, spot long, crowded boolean")


def cut_again(rows: DataFrame, seed: int) -> DataFrame:
    """The same pieces cut by the anchors of another order of k-mers."""
    def run(batches):
        for b in slices(batches, 20_000):
            data, ends = joined(b.column(1).to_pylist())
            place, size, anchor = pieces(data, ends, seed)
            which = np.searchsorted(ends, place, "right")
            size = size + WINDOW - 1
            cuts = np.cumsum(size)
            flat = data[np.repeat(place - (cuts - size), size) + np.arange(cuts[-1] if len(cuts) else 0)]
            at = pa.array(which)
            spot = b.column(4).to_numpy()[which] + place - np.concatenate([[0], ends[:-1]])[which]
            # Both anchors name the new bucket: windows that are equal agree in both.
            both = (b.column(0).to_numpy()[which].view(M) * M(MULTIPLIERS[3]) ^ anchor).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both), packed(flat, cuts), b.column(2).take(at), b.column(3).take(at), pa.array(spot)], ["anchor", "piece", "id", "key", "spot"])

    return rows.select("anchor", "piece", "id", "key", "spot").mapInArrow(run, "anchor long, piece binary, id long, key long, spot long")


def dealt_pieces(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n, size, block): the distinct pieces of rows (anchor, name, piece, low, high) with their least and greatest id, by bucket and anchor; the columns of a
    block stand one behind the other, compressed, as pieces without their neighbours in a text take several times its bytes.
    """
    def close(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        anchor, name, low, high = (t.column(k).to_numpy() for k in ("anchor", "name", "low", "high"))
        bucket = bucket_of(anchor, buckets)
        order, head, low, high = distinct(anchor, name, low, high, bucket)
        text = t.column("piece").take(pa.array(order[head])).combine_chunks()
        raw, edge = text_of(text)
        anchor, name, bucket = (x[order[head]] for x in (anchor, name, bucket))
        kind, first = np.unique(bucket, return_index=True)
        columns: list[list] = [[], [], [], []]
        for k, i, j in zip(kind.tolist(), first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True):
            block = b"".join([*(x[i:j].tobytes() for x in (anchor, name, low, high - low)), np.diff(edge[i : j + 1]).astype(np.uint8).tobytes(), raw[edge[i] : edge[j]].tobytes()])
            for x, y in zip(columns, (k, j - i, len(block), pa.compress(block, "zstd", asbytes=True)), strict=True):
                x.append(y)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["bucket", "n", "size", "block"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.column(2).nbytes
            if size >= BLOCK:
                yield close(held)
                held, size = [], 0
        if held and sum(b.num_rows for b in held):
            yield close(held)

    return rows.select("anchor", "name", "piece", "low", "high").mapInArrow(run, "bucket long, n long, size long, block binary")


def text_of(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of binary values one behind the other, and the edges between them."""
    x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
    edge = np.frombuffer(x.buffers()[1], np.int64 if x.type == pa.large_binary() else np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64)
    return np.frombuffer(x.buffers()[2] or b"", np.uint8)[edge[0] : edge[-1]], edge - edge[0]


def distinct(anchor: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray, *before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of ``before``, anchor and name, where each distinct (anchor, name) begins in it, its least ``low`` and its greatest ``high``."""
    order = np.lexsort((name, anchor, *before))
    a, n = anchor[order], name[order]
    head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (n[1:] != n[:-1])]))
    return order, head, np.minimum.reduceat(low[order], head), np.maximum.reduceat(high[order], head)


def stretches(rows: DataFrame, buckets: int) -> DataFrame:
    """(anchor, name, first, last, lowest): stretches of windows of a distinct piece that a smaller id than its greatest has, and the least such id.

    ``rows`` holds (anchor, name, piece, low, high), a piece as often as you like. Whole anchors are put together up to COLLECTION symbols.
    """
    def close(blocks: list[tuple]):
        fixed: list[list[np.ndarray]] = [[], [], [], [], []]
        texts = []
        for n, size, block in blocks:
            raw = np.frombuffer(pa.decompress(block, size, "zstd", asbytes=True), np.uint8)
            numbers = raw[: 32 * n].view(np.int64).reshape(4, n)
            for x, y in zip(fixed, (*numbers, raw[32 * n : 33 * n]), strict=True):
                x.append(y)
            texts.append(raw[33 * n :])
        anchor, name, low, more, length = (np.concatenate(x) for x in fixed)
        text, length = np.concatenate(texts), length.astype(np.int64)
        start = np.cumsum(length) - length
        order, head, low, high = distinct(anchor, name, low, low + more)
        at = order[head]
        anchor, name, start, length = anchor[at], name[at], start[at], length[at]
        group = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        members, symbols = np.diff(np.append(group, len(anchor))), np.add.reduceat(length, group)
        # A piece that has its anchor for itself shares no window with another.
        alone = np.flatnonzero(np.repeat(members == 1, members) & (low < high))
        yield found(anchor[alone], name[alone], alone * 0, length[alone] - WINDOW, low[alone])
        several = np.flatnonzero(members > 1)
        total, at = np.cumsum(symbols[several]), 0
        while at < len(several):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + COLLECTION, "right")))
            g = several[at:to]
            count = members[g]
            k = np.arange(count.sum()) + np.repeat(group[g] - (np.cumsum(count) - count), count)
            size = length[k]
            ends = np.cumsum(size)
            data = text[np.repeat(start[k] - (ends - size), size) + np.arange(ends[-1])]
            seen, windows = first_seen(data, ends, low[k]), size - WINDOW + 1
            who = np.repeat(np.arange(len(k)), windows)
            edge = np.flatnonzero(np.concatenate([[True], (seen[1:] != seen[:-1]) | (who[1:] != who[:-1])]))
            run_of = np.diff(np.append(edge, len(seen)))
            first = edge - (np.cumsum(windows) - windows)[who[edge]]
            keep = seen[edge] < high[k][who[edge]]
            w = k[who[edge]][keep]
            yield found(anchor[w], name[w], first[keep], (first + run_of - 1)[keep], seen[edge][keep])
            at = to

    def found(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["anchor", "name", "first", "last", "lowest"])

    def run(batches):
        held: list[tuple] = []
        now = None
        for b in slices(batches, 256):
            for bucket, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and bucket != now:
                    yield from close(held)
                    held = []
                now = bucket
                held.append(row)
        if held:
            yield from close(held)

    return dealt_pieces(rows, buckets).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "anchor long, name long, first long, last long, lowest long")


def hits(found: DataFrame, buckets: int) -> tuple[DataFrame, list[DataFrame]]:
    """(id, key, spot, first, last) of all stretches of pieces that go, and the saved tables that it reads.

    Pieces of an anchor with over LIMIT symbols are cut again by the anchors of another order of k-mers, and again, until none has so many or nothing
    changes. Distinct pieces of anchors that may have so many are found by Spark, so that no bucket gets all their copies.
    """
    out, tables, now = [], [found], found
    for seed in range(1, 1 + SPREAD):
        named, low = now.withColumn("name", F.xxhash64("piece")), F.coalesce("id", F.lit(int(NOBODY)))
        crowd = step(named.where("crowded").groupBy("anchor", "name", "piece").agg(F.min(low).alias("low"), F.max(low).alias("high")))
        heavy = step(crowd.groupBy("anchor").agg(F.sum(F.octet_length("piece")).alias("symbols")).where(F.col("symbols") > LIMIT).select("anchor"))
        tables += [crowd, heavy]
        last = seed == SPREAD or heavy.isEmpty()
        seen = step(stretches(named.where("not crowded").select("anchor", "name", "piece", low.alias("low"), low.alias("high")).unionByName(crowd if last else crowd.join(heavy, "anchor", "left_anti")), buckets))
        tables.append(seen)
        hit = named.select("anchor", "name", "id", "key", "spot").join(seen, ["anchor", "name"]).where(F.col("id").isNull() | (F.col("lowest") < F.col("id")))
        out.append(hit.select("id", "key", "spot", "first", "last"))
        if last:
            break
        again = step(cut_again(now.where("crowded").join(heavy, "anchor", "left_semi"), seed))
        tables.append(again)
        now = again.withColumn("crowded", F.lit(True))
    return union_of(out), tables


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as it ends, so that those of two steps never add up."""
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        yield
    finally:
        spark.conf.set(cleanup, before)


def step(df: DataFrame) -> DataFrame:
    """``df`` saved, without what its shuffles leave."""
    with passing(df.sparkSession):
        return saved(df, "zstd")


def union_of(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def key_of(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def remove(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept (bytes that remain), spans (starts and ends of what went, in bytes).

    Texts are UTF-8 bytes, null is empty; texts shorter than a window keep everything. Ids are whole numbers; rows with one id never remove from one another, rows without an id
    come last and remove nothing. Very long texts are cut like all others; repeated rows give repeated results; other columns are ignored; an empty table gives an empty
    result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), key_of(id_col, text_col).alias("key"))
    with passing(docs.sparkSession):
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, total // BUCKET)
    parts = step(shared(dealt(rows.where(F.octet_length("text") >= WINDOW).select("key", "text"), buckets), LIMIT))
    known = parts.groupBy("key").agg(F.collect_list(F.struct("spots", "anchors")).alias("found"))
    found = step(contents(rows.join(known, "key").select("id", "key", "text", "found")))
    drop_saved(parts)
    hit, tables = hits(found, buckets)
    spans = step(hit.select("id", "key", (F.col("spot") + F.col("first")).alias("a"), (F.col("spot") + F.col("last") + WINDOW).alias("z")).groupBy("id", "key").agg(F.collect_list(F.struct("a", "z")).alias("spans")))
    drop_saved(*tables)
    a, b = rows.alias("a"), spans.alias("b")
    every = a.join(b, (F.col("a.key") == F.col("b.key")) & F.col("a.id").eqNullSafe(F.col("b.id")), "left").select("a.id", "a.text", F.col("b.spans.a").alias("first"), F.col("b.spans.z").alias("last"))

    def run(batches):
        for batch in slices(batches, 500):
            out: list[list] = [[], [], [], [], []]
            for text, first, last in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                merged = union(first, last, len(text)) if first else []
                bounds = [0, *merged, len(text)]
                kept = b"".join(text[bounds[k] : bounds[k + 1]] for k in range(0, len(bounds), 2))
                for x, y in zip(out, (len(text), len(text) - len(kept), len(merged) // 2, kept, merged), strict=True):
                    x.append(y)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    return every.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<long>").withColumnRenamed("id", id_col)


def union(first: list[int], last: list[int], size: int) -> list[int]:
    """Starts and ends of the maximal stretches that intervals cover, inside a text of ``size`` bytes."""
    order = np.argsort(first, kind="stable")
    a, z = np.array(first, np.int64)[order], np.maximum.accumulate(np.minimum(np.array(last, np.int64)[order], size))
    new = np.flatnonzero(np.concatenate([[True], a[1:] > z[:-1]]))
    return np.column_stack([a[new], z[np.append(new[1:], len(a)) - 1]]).ravel().tolist()
