"""Byte-pair encoding by speculation: greedy tokens, pairwise checks, exact merging where they fail.

A sequence of tokens is what exact merging gives if and only if every adjacent pair is: no merge
across their border would have run before the merges that built the two tokens. So each new word is
cut greedily into longest tokens (one automaton over all new words), all adjacent pairs of a batch of words
are tested at once in numpy, and only words with a failing pair are merged step by step, words of one
length side by side.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from spanforge.llm.common import chunks, map_batches, slices, strings

#: Fixed value: the published split pattern of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters below this one are split with the standard library.
LOW = 0x250
#: Words of a generation of a worker's memory; the last two generations are kept, which is a matter of time only.
CACHE_WORDS = 250_000
#: Words of so many bytes are merged by scanning, longer ones with a heap.
SHORT = 32
#: Fewer words of one length are merged one by one.
FEW = 12
#: Stands between words where the greedy automaton reads many; no byte is written so.
BORDER = chr(256)
#: Longer words are not kept.
CACHE_LENGTH = 64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return letters | {chr(256 + k): b for k, b in enumerate(rest)}


def check_spec(spec: dict) -> None:
    """Refuse vocabulary files that ask for steps which this encoder does not take."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
        raise ValueError("only byte-level BPE without normalizer, dropout, affixes and ignored merges")
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or pre.get("use_regex") is False:
        raise ValueError("only the byte-level split without a prefix space")
    if (spec.get("post_processor") or {"type": "ByteLevel"})["type"] != "ByteLevel" or (spec.get("decoder") or {}).get("type") != "ByteLevel":
        raise ValueError("only byte-level decoding, no template")
    if any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError("added tokens must stand as they are written")


class Recent(dict):
    """Words and what is known of them: those of the last two generations."""

    def __init__(self, limit: int = CACHE_WORDS):
        super().__init__()
        self.limit, self.older = limit, {}

    def __missing__(self, word: str):
        """Raises KeyError for an unknown word; one of the older generation moves on."""
        self[word] = found = self.older[word]
        return found

    def learn(self, found: dict) -> None:
        """Take in what is new; ``words`` longer than CACHE_LENGTH are not for keeping and stay out."""
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()
        self.update((w, x) for w, x in found.items() if len(w) <= CACHE_LENGTH)


class Found(dict):
    """The words just encoded, then those remembered."""

    def __init__(self, fresh: dict, words: Recent):
        super().__init__(fresh)
        self.words = words

    def __missing__(self, word: str):
        self[word] = found = self.words[word]
        return found


class PairRanks:
    """The rank of a merge by its pair, for arrays of pairs: a table with open addressing."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        left, at = np.arange(len(keys)), self.slot(keys)
        while len(left):
            free = self.keys[at] < 0
            self.ranks[at[free]] = left[free]
            won = free & (self.ranks[at] == left)
            self.keys[at[won]] = keys[left[won]]
            left, at = left[~won], (at[~won] + 1) & (len(self.keys) - 1)
        used = self.keys >= 0
        self.ranks[used] = ranks[self.ranks[used]]

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray, none: int) -> np.ndarray:
        """Ranks, ``none`` for pairs that never merge."""
        at = self.slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], none)
        live = np.flatnonzero((found != keys) & (found >= 0))
        while len(live):
            at[live] = (at[live] + 1) & (len(self.keys) - 1)
            found = self.keys[at[live]]
            hit = found == keys[live]
            out[live[hit]] = self.ranks[at[live[hit]]]
            live = live[~hit & (found >= 0)]
        return out


class SpeculativeBPE:
    """Encoder and decoder of one vocabulary file; loads lazily in each worker process."""

    loaded: dict[str, SpeculativeBPE] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_spec(spec)
        of, vocab = byte_letters(), spec["model"]["vocab"]
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for word, k in vocab.items():
            self.bytes_of[k] = bytes(of[c] for c in word)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, k in self.special.items():
            self.bytes_of[k] = content.encode()
        self.id_of = {b: k for k, b in enumerate(self.bytes_of) if k not in self.special.values()}
        n = len(self.bytes_of)
        self.left, self.right, self.rank = np.arange(n), np.arange(n), np.full(n, -1)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys, self.merges, self.made = np.empty(len(pairs), np.int64), {}, []
        for r, (a, b) in enumerate(pairs):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            keys[r] = x << 32 | y
            self.merges[x << 32 | y] = r
            self.made.append(z)
            if self.rank[z] < 0:
                self.left[z], self.right[z], self.rank[z] = x, y, r
        self.pairs, self.made_of = PairRanks(keys, np.arange(len(keys))), np.array(self.made, np.int64)
        self.letter = np.array([self.id_of[bytes([k])] for k in range(256)], np.int64)
        self.machine = ahocorasick.Automaton()
        for b, k in self.id_of.items():
            if b:
                self.machine.add_word(b.decode("latin-1"), k)
        self.machine.make_automaton()
        self.longest = max(map(len, self.id_of))
        self.split = regex.compile(SPLIT)
        # The same split for texts of low characters, whose classes the standard library can hold as bitmaps: twice as fast.
        letters, digits, spaces = ("".join(re.escape(chr(k)) for k in range(LOW) if regex.match(c, chr(k))) for c in (r"\p{L}", r"\p{N}", r"\s"))
        low = SPLIT.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{digits}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{digits}]").replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]")
        self.low_split, self.high = re.compile(low), re.compile(f"[^\\x00-{chr(LOW - 1)}]")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.longest_special = max(map(len, self.special), default=0)
        self.words = Recent()
        self.checked = self.failed = 0

    @classmethod
    def load(cls, path: str) -> SpeculativeBPE:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def greedy_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The longest tokens from left to right of each word, one after the other, and the word of each."""
        text = BORDER.join([w.decode("latin-1") for w in words])
        found = np.fromiter(chain.from_iterable(self.machine.iter_long(text)), np.int64).reshape(-1, 2)
        ends = np.cumsum([len(w) + 1 for w in words])
        return found[:, 1], np.searchsorted(ends, found[:, 0], side="right")

    def greedy(self, word: bytes) -> list[int]:
        out, at, n, get = [], 0, len(word), self.id_of.get
        while at < n:
            end = min(n, at + self.longest)
            while (k := get(word[at:end])) is None:
                end -= 1
            out.append(k)
            at = end
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens side by side: exact merging leaves them so.

        Undoes the latest merge of either side again and again; at each state the tokens that face each
        other exist until the merge just undone, so a merge of the two with a lower rank (or the same
        rank, if it stands to the left of that merge) would have come first.
        """
        ok, a, b = np.ones(len(a), bool), a.copy(), b.copy()
        none = len(self.made)
        limit, live = np.full(len(a), none), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            bad = self.pairs.get(x << 32 | y, none) < limit[live]
            ok[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & (np.maximum(rx, ry) >= 0)
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            first = rx > ry
            a[live] = np.where(first, self.right[x], x)
            b[live] = np.where(first, y, self.left[y])
            limit[live] = np.where(first, rx, ry + 1)
        return ok

    def exact(self, word: bytes) -> list[int]:
        """Merge the lowest rank first, the leftmost on ties."""
        ids = [self.id_of[word[k : k + 1]] for k in range(len(word))]
        return self.merge_short(ids) if len(ids) <= SHORT else self.merge_long(ids)

    def exact_many(self, words: list[bytes]) -> list[bytes]:
        """:meth:`exact` of many words, as little-endian 32-bit integers; short words of one length are merged side by side."""
        out: list = [None] * len(words)
        of_length: dict[int, list[int]] = defaultdict(list)
        for k, w in enumerate(words):
            of_length[len(w)].append(k)
        for length, at in of_length.items():
            if 1 < length <= SHORT and len(at) >= FEW:
                merged = self.merge_beside(np.frombuffer(b"".join([words[k] for k in at]), np.uint8).reshape(-1, length))
            else:
                merged = [np.array(self.exact(words[k]), "<u4").tobytes() for k in at]
            for k, ids in zip(at, merged, strict=True):
                out[k] = ids
        return out

    def merge_beside(self, letters: np.ndarray) -> list[bytes]:
        """Words of one length, a row each: every step makes the first merge of each word that has one left."""
        none, (n, size) = len(self.made), letters.shape
        ids = np.ascontiguousarray(self.letter[letters].T)
        # Rank and place in one number, so that the least is the lowest rank and the leftmost place of it.
        rank = np.full((size, n), none << 6, np.int64)
        rank[:-1] = self.pairs.get((ids[:-1] << 32 | ids[1:]).ravel(), none).reshape(size - 1, n) << 6 | np.arange(size - 1)[:, None]
        after = np.repeat(np.arange(1, size + 1, dtype=np.int64)[:, None], n, 1)
        before = np.repeat(np.arange(-1, size - 1, dtype=np.int64)[:, None], n, 1)
        live, inner = np.arange(n), rank
        while True:
            least = inner.min(0)
            go = least < none << 6
            if not go.all():
                rank[:, live] = inner
                live, inner, least = live[go], np.ascontiguousarray(inner[:, go]), least[go]
            if not len(live):
                break
            here, k = np.arange(len(live)), least & 63
            j = after[k, live]
            ids[k, live], ids[j, live] = self.made_of[least >> 6], -1
            inner[j, here] = none << 6
            far = after[j, live]
            after[k, live] = far
            more = far < size
            before[far[more], live[more]] = k[more]
            left = before[k, live]
            both = np.concatenate([k, left])
            w, h = np.concatenate([live, live]), np.concatenate([here, here])
            right = np.concatenate([far, k])
            fine = (both >= 0) & (right < size)
            new = np.full(len(both), none, np.int64)
            new[fine] = self.pairs.get(ids[both[fine], w[fine]] << 32 | ids[right[fine], w[fine]], none)
            there = both >= 0
            inner[both[there], h[there]] = new[there] << 6 | both[there]
        flat, left = ids.T.ravel(), (ids >= 0).sum(0)
        flat, cuts = flat[flat >= 0].astype("<u4").tobytes(), (4 * np.cumsum([0, *left])).tolist()
        return [flat[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]

    def merge_short(self, ids: list[int]) -> list[int]:
        """By scanning the ranks of all neighbours after each merge."""
        get, none = self.merges.get, len(self.made)
        ranks = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (r := min(ranks)) < none:
            k = ranks.index(r)
            ids[k] = self.made[r]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = get(ids[k - 1] << 32 | ids[k], none)
            if k < len(ranks):
                ranks[k] = get(ids[k] << 32 | ids[k + 1], none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """By a heap of neighbours, for words without a bound on their length."""
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(len(ids) - 1) if (r := self.merges.get(ids[k] << 32 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, x, y = heapq.heappop(heap)
            j = after[k]
            if ids[k] != x or j < 0 or ids[j] != y:
                continue
            ids[k], ids[j], after[k] = self.made[r], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for p in (before[k], k):
                if p >= 0 and after[p] >= 0 and (r := self.merges.get(ids[p] << 32 | ids[after[p]])) is not None:
                    heapq.heappush(heap, (r, p, ids[p], ids[after[p]]))
        return [k for k in ids if k >= 0]

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words, as little-endian 32-bit integers."""
        if not words:
            return {}
        raw = [w.encode() for w in words]
        flat, owner = self.greedy_many(raw)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
        ok = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        self.checked += len(words)
        cuts = 4 * np.searchsorted(owner, np.arange(len(words) + 1))
        whole, cuts = flat.astype("<u4").tobytes(), cuts.tolist()
        out = {w: whole[x:y] for w, x, y in zip(words, cuts[:-1], cuts[1:], strict=True)}
        failed = np.unique(owner[inner[~ok]]).tolist()
        self.failed += len(failed)
        for k, ids in zip(failed, self.exact_many([raw[k] for k in failed]), strict=True):
            out[words[k]] = ids
        return out

    def splitter(self, text: str):
        """The compiled split pattern for a text."""
        return self.low_split if self.high.search(text) is None else self.split

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens; special tokens stand as they are, found before the text is split."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.splitter(text).findall(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.special else self.splitter(part).findall(part)
        return out

    def pieces_from(self, text: str, at: int) -> Iterator[str]:
        """The pre-tokens of ``text`` from character ``at``, a border, on; found one by one."""
        found, n = self.splitter(text), len(text)
        while at < n:
            special = self.cut.search(text, at) if self.cut else None
            stop = special.start() if special else n
            yield from (m[0] for m in found.finditer(text, at, stop))
            if special:
                yield special[0]
            at = special.end() if special else n

    def encode_batch(self, texts: list[str], chunk: int = 1_000_000) -> list[bytes]:
        """The ids of each whole text; new words are checked together, about ``chunk`` characters at a time."""
        out = []
        for at, end in chunks(texts, chunk):
            pieces = [self.pieces(x) for x in texts[at:end]]
            special = {s: np.array([k], "<u4").tobytes() for s, k in self.special.items()}
            known = self.words.older
            fresh = self.encode_words([w for w in {w for p in pieces for w in p} if w not in self.words and w not in known and w not in special])
            # A word that is too long for the memory, or that a new generation has dropped, is found here.
            now = Found(fresh | special, self.words)
            out += [b"".join(map(now.__getitem__, p)) for p in pieces]
            self.words.learn(fresh)
        return out

    def decode(self, ids: bytes | np.ndarray) -> str:
        """The text of some ids; bytes that are not UTF-8 become U+FFFD."""
        ids = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else ids
        of = self.bytes_of
        return b"".join([of[k] for k in ids.tolist()]).decode("utf-8", "replace")


def listed(ids: list[bytes]) -> pa.ListArray:
    """Encoded ids as an Arrow array of lists, without Python integers."""
    offsets = np.cumsum([0, *(len(x) // 4 for x in ids)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def encode(docs: DataFrame, path: str, *, text_col: str = "text", check_col: str | None = None) -> DataFrame:
    """``docs`` with a column ``ids`` (array<int>); null and empty texts get an empty array.

    ``check_col`` names one more column: whether decoding the ids gives the text (null: the empty text)
    again, tested in the same pass. Raises if ``docs`` has a column of one of these names already. Rows are
    independent: ties and repeats need no rule.
    """
    added = ["ids", *([check_col] if check_col else [])]
    if clash := set(added) & set(docs.columns):
        raise ValueError(f"docs already has {sorted(clash)}")
    schema = StructType([*docs.schema.fields, StructField("ids", ArrayType(IntegerType())), *([StructField(check_col, BooleanType())] if check_col else [])])

    def run(batches):
        bpe = SpeculativeBPE.load(path)
        for b in slices(batches):
            texts = strings(b, text_col)
            ids = bpe.encode_batch(texts)
            more = [pa.array([bpe.decode(i) == x for i, x in zip(ids, texts, strict=True)], pa.bool_())] if check_col else []
            yield pa.RecordBatch.from_arrays([*b.columns, listed(ids), *more], [*b.schema.names, *added])

    return docs.mapInArrow(run, schema)


def decode(coded: DataFrame, path: str, *, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``coded`` with the decoded text of its ids; null ids give an empty text."""
    if text_col in coded.columns:
        raise ValueError(f"coded already has a column {text_col}")
    schema = StructType([*coded.schema.fields, StructField(text_col, StringType())])

    def run(batches):
        bpe = SpeculativeBPE.load(path)
        for b in slices(batches):
            column = b.column(b.schema.get_field_index(ids_col))
            ids, cuts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            there = column.is_valid().to_pylist()
            texts = [bpe.decode(ids[x:y]) if ok else "" for x, y, ok in zip(cuts[:-1], cuts[1:], there, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, text_col])

    return coded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 of its whole text, encoded and decoded in one pass.

    Null texts are empty; repeated rows give repeated results; other columns are ignored; an empty table gives an empty result; a very
    long text is a chunk of its own. The same encoder and decoder as :func:`encode` and :func:`decode`, without sending the ids through Spark.
    """
    def run(b: pa.RecordBatch) -> dict[str, object]:
        bpe = SpeculativeBPE.load(path)
        coded = bpe.encode_batch(strings(b, "text"))
        return {
            "id": b.column(0), "n_tokens": [len(x) // 4 for x in coded], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in coded],
            "decoded_sha256": [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in coded],
        }

    kind = {"bigint": "long"}.get(k := docs.schema[id_col].dataType.simpleString(), k)
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(df, run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
