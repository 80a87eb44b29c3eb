"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Texts are folded alike on both sides: A-Z lowered, words are runs of letters, digits and non-ASCII
characters. The automaton reads words, not characters: every word of an item has a number, written as one letter (as two where
there are over a million), and all other words share one. Any ``window`` consecutive words of an item hold one of its
aligned blocks of half as many, so the automaton holds those blocks, as many letters in all as the items have words, and a
block that it finds is compared with the item's words around it. Items of fewer words are one window,
held whole. Each document is scanned once; word numbers map back to the original characters.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import WORD, folded_words, map_batches, slices, strings

#: Bytes of item text in one automaton, which takes about ten times as many in a worker; more items are scanned in as many passes as it takes.
PASS_BYTES = 32 << 20
#: Letters that words are written with, and block matches compared at once.
LETTERS, PAIRS = 1_000_000, 1 << 17
#: Words of no item, and what stands between items.
OTHER, BORDER = -2, -1


def letter(k: int) -> str:
    """Letter number ``k``, without surrogates; 0 stands for words of no item."""
    return chr(k if k < 0xD800 else k + 0x800)


class Automaton:
    """All items; built on first use in each worker from their texts."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.items, self.window, self.machine = items, window, None

    def __getstate__(self):
        return {"items": self.items, "window": self.window, "machine": None}

    def build(self) -> None:
        number: dict[bytes, int] = {}
        words, owner = [], []
        for k, (_, text) in enumerate(self.items):
            own = [number.setdefault(w, len(number)) for w in folded_words(text)]
            if own:
                words.append(own)
                owner.append(k)
        w, self.block = self.window, (self.window + 1) // 2
        self.width = 1 if len(number) < LETTERS - 1 else 2
        # Word numbers of all items, a border after each, room for comparisons at both ends.
        sizes = np.array([len(x) for x in words], np.int64)
        self.words = np.full(int(sizes.sum()) + len(words) + 2 * w, BORDER, np.int32)
        self.item_of = np.full(len(self.words), -1, np.int32)
        at, short = w, set()
        places: dict[str, list[int]] = defaultdict(list)
        code = [letter(k + 1) if self.width == 1 else letter(k // (LETTERS - 1) + 1) + letter(k % (LETTERS - 1) + 1) for k in range(len(number))]
        for k, own in zip(owner, words, strict=True):
            self.words[at : at + len(own)] = own
            self.item_of[at : at + len(own)] = k
            if len(own) < w:
                short.add(k)
                places["".join([code[x] for x in own])].append(at)
            else:
                for x in range(0, len(own) - self.block + 1, self.block):
                    places["".join([code[y] for y in own[x : x + self.block]])].append(at + x)
            at += len(own) + 1
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.cuts = np.cumsum([0, *map(len, places.values())])
        self.places = np.fromiter((x for p in places.values() for x in p), np.int64, int(self.cuts[-1]))
        self.lengths = np.fromiter((len(k) // self.width for k in places), np.int64, len(places))
        # Of each place, whether its item is one window.
        self.whole = np.fromiter((k in short for k in self.item_of[self.places].tolist()), bool, len(self.places))
        for k, key in enumerate(places):
            self.machine.add_word(key, k)
        if places:
            self.machine.make_automaton()
        self.code = {x: c for x, c in zip(number, code, strict=True)}
        self.number = number

    def scan(self, text: str) -> tuple[int, np.ndarray, set[str]]:
        """Words in the text, a flag for each that is hit (none if no word is), ids of items that occur."""
        if self.machine is None:
            self.build()
        words = folded_words(text)
        none: np.ndarray = np.zeros(0, bool)
        if not words or not len(self.machine):
            return len(words), none, set()
        get, other = self.code.get, letter(0) * self.width
        found = list(self.machine.iter("".join([get(x, other) for x in words])))
        if self.width > 1:
            found = [(e // self.width, k) for e, k in found if e % self.width == self.width - 1]
        if not found:
            return len(words), none, set()
        ends, keys = np.array(found, np.int64).T
        w = self.window
        line = np.full(len(words) + 2 * w, OTHER, np.int32)
        line[w:-w] = [self.number.get(x, OTHER) for x in words]
        hit, seen = np.zeros(len(words) + 1, np.int64), set()
        count = np.cumsum(self.cuts[keys + 1] - self.cuts[keys])
        at = 0
        while at < len(keys):
            end = max(at + 1, int(np.searchsorted(count, (count[at - 1] if at else 0) + PAIRS)))
            self.compare(line, ends[at:end], keys[at:end], hit, seen)
            at = end
        return len(words), np.cumsum(hit)[:-1] > 0 if seen else none, {self.items[k][0] for k in seen}

    def compare(self, line: np.ndarray, ends: np.ndarray, keys: np.ndarray, hit: np.ndarray, seen: set[int]) -> None:
        """Mark the words of all windows around the blocks ``keys`` that end at ``ends``; a block may stand at many places."""
        w = self.window
        n = self.cuts[keys + 1] - self.cuts[keys]
        which = np.repeat(np.arange(len(keys)), n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + self.cuts[keys][which]
        place, whole = self.places[at], self.whole[at]
        size = self.lengths[keys][which]
        first = ends[which] - size + 1
        # Equal words to the left and to the right, as far as a window with the block in it can reach.
        left, right = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        on = ~whole
        for k in range(1, w - self.block + 1):
            on = on & (line[w + first - k] == self.words[place - k])
            left += on
        on = ~whole
        for k in range(w - self.block):
            on = on & (line[np.minimum(w + first + size + k, len(line) - 1)] == self.words[place + size + k])
            right += on
        good = whole | (left + size + right >= w)
        np.add.at(hit, (first - left)[good], 1)
        np.add.at(hit, (first + size + right)[good], -1)
        seen.update(np.unique(self.item_of[place[good]]).tolist())


def char_spans(text: str, hit: np.ndarray) -> list[int]:
    """Start and end of each run of hit words, in code points of the original text, flattened."""
    out: list[int] = []
    raw = text.encode()
    before = 0
    for k, m in enumerate(WORD.finditer(raw)):
        if hit[k] and not (k and hit[k - 1]):
            before = m.start()
        if hit[k] and not (k + 1 < len(hit) and hit[k + 1]):
            start = len(raw[:before].decode())
            out += [start, start + len(raw[before : m.end()].decode())]
    return out


def passes(items: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[Automaton]:
    """Automata over all items, each of at most PASS_BYTES of text (or of one longer item)."""
    part: list[tuple[str, str]] = []
    size = 0
    rows = items.select(F.col(id_col).cast("string"), F.coalesce(text_col, F.lit("")))
    for item, text in rows.toLocalIterator():
        if part and size + len(text.encode()) > PASS_BYTES:
            yield Automaton(part, window)
            part, size = [], 0
        part.append((item, text))
        size += len(text.encode())
    yield Automaton(part, window)


def hits(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """One row per document row: id, n_words, n_hit, ids of the items that occur, original spans.

    Null and empty texts have no words and no hits; a very long text is scanned as one; items without words match nothing; repeated item
    ids count once, and items without an id count as one with a null id, which stands last; repeated document rows give repeated results; other columns are ignored. With no
    items nothing is hit. Item text beyond PASS_BYTES is scanned in several passes over the documents,
    whose hit words are united by row, so that no automaton outgrows a worker.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scans = [scanned(docs, a) for a in passes(items, item_id, item_text, window)]
    if len(scans) == 1:
        return scans[0].withColumnRenamed("id", id_col)
    every = scans[0]
    for s in scans[1:]:
        every = every.unionByName(s)
    # The same text gives the same hits in every pass, so repeated rows are restored by their count.
    united = every.groupBy("id", "digest").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_words")))).alias("hit_words"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), (F.count("*") / len(scans)).cast("int").alias("copies"))
    return united.withColumn("n_hit", F.size("hit_words").cast("long")).withColumn("copies", F.explode(F.array_repeat("copies", F.col("copies")))).select(F.col("id").alias(id_col), "digest", "n_words", "n_hit", "items", "hit_words", "spans")


def scanned(docs: DataFrame, automaton: Automaton) -> DataFrame:
    """One pass of one automaton; it is broadcast, so that a worker builds it once."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    kind = docs.schema["id"].dataType.simpleString()
    kind = {"bigint": "long"}.get(kind, kind)

    def scan(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = defaultdict(list)
        for text in strings(batch, "text"):
            n, hit, ids = shared.value.scan(text)
            some = hit.any() if len(hit) else False
            out["n_words"].append(n)
            out["n_hit"].append(int(hit.sum()))
            out["items"].append(sorted(ids, key=lambda x: (x is None, x or "")))
            out["hit_words"].append(np.flatnonzero(hit).tolist() if some else [])
            out["spans"].append(char_spans(text, hit) if some else [])
            out["digest"].append(hashlib.md5(text.encode()).digest())
        return {**out, "id": batch.column(0)}

    return map_batches(docs, scan, f"id {kind}, digest binary, n_words long, n_hit long, items array<string>, hit_words array<int>, spans array<long>")


def keep_clean(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """The rows of ``docs``, all columns as they are, in whose text no window of an item occurs.

    Null, empty and wordless texts stay; repeated rows stay or go together; a very long text is scanned whole; items with null ids count like others; without items all
    rows stay, and an empty table gives an empty one.
    """
    for a in passes(items, item_id, item_text, window):
        def keep(batches, shared=docs.sparkSession.sparkContext.broadcast(a)):
            for b in slices(batches):
                yield b.filter(pa.array([not shared.value.scan(x)[2] for x in strings(b, text_col)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
