"""Token counts that follow edits.

Each document keeps a segment tree over its pre-tokens: a leaf is a run of pre-tokens, of which it holds the
lengths in characters and in tokens, inner nodes hold the sums. The trees are a table of their own,
kept in shared storage and read by the next run: an edit goes down the sums to its place, re-splits from shortly
before it up to the first border that the old split had too, re-encodes those pre-tokens alone, and updates the
sums above the leaves it touched. Text that no edit touches is neither split nor encoded again.
Special tokens count as in ``bpe``: one token each, found before the text is split.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanforge.llm.bpe import Recent, SpeculativeBPE
from spanforge.llm.common import chunks, slices, strings

#: Pre-tokens of a leaf when a tree is laid out; one that would grow beyond twice as many has the tree laid out again, from sums alone.
LEAF = 64
#: Characters after the end of a pre-token that can decide where it ends.
AHEAD = 2
#: Characters read at first behind an edit to find an old border; doubled while none is found.
REACH = 64
#: Fewer new words than this are not worth a vectorised check.
FEW = 40
#: Columns of a tree: characters and tokens of each pre-token, and pre-tokens, characters and tokens of each leaf, as little-endian integers.
TREE = "sizes binary, leaves binary, n_pretokens long, n_tokens long"


class Counter:
    """Tokens of pre-tokens, remembered in each worker."""

    loaded: dict[str, Counter] = {}

    def __init__(self, bpe: SpeculativeBPE):
        self.bpe, self.known = bpe, Recent()
        self.special = dict.fromkeys(bpe.special, 1)

    @classmethod
    def load(cls, path: str) -> Counter:
        if path not in cls.loaded:
            cls.loaded[path] = cls(SpeculativeBPE.load(path))
        return cls.loaded[path]

    def count(self, words: list[str]) -> list[int]:
        """Tokens of each; new words of many are checked together, a few are merged one by one."""
        get, older, special = self.known.get, self.known.older.get, self.special.get
        out = [get(w) for w in words]
        if None in out:
            fresh = {w: special(w) or older(w) for w, n in zip(words, out, strict=True) if n is None}
            new = [w for w, n in fresh.items() if n is None]
            fresh |= {w: len(self.bpe.exact(w.encode())) for w in new} if len(new) < FEW else {w: len(t) // 4 for w, t in self.bpe.encode_words(new).items()}
            out = [n if n is not None else fresh[w] for w, n in zip(words, out, strict=True)]
            self.known.learn(fresh)
        return out


class Tree:
    """The segment tree of one text; leaves are cut out of the stored arrays when an edit first touches them."""

    def __init__(self, text: str, sizes: np.ndarray, leaves: np.ndarray, counter: Counter):
        """``sizes``: (2, pre-tokens), ``leaves``: (3, leaves), see TREE."""
        self.base, self.sizes, self.counter, self.reencoded = text, sizes, counter, 0
        self.n, chars, tokens = leaves.tolist()
        # Where each leaf of the stored arrays stands, in pre-tokens and in characters; what edits made of it instead.
        self.at, self.starts = ([0, *accumulate(x[:-1])] for x in (self.n, chars))
        self.own: list[tuple[str, list[int], list[int]] | None] = [None] * len(self.n)
        self.build(chars, tokens)

    def build(self, chars: list[int], tokens: list[int]) -> None:
        """Sums of characters and of tokens, a heap each: node k is above nodes 2k and 2k + 1."""
        w = self.width = 1 << max(0, len(chars) - 1).bit_length()
        rest = [0] * (w - len(chars))
        self.chars, self.tokens = [0] * w + chars + rest, [0] * w + tokens + rest
        for heap in (self.chars, self.tokens):
            for k in range(w - 1, 0, -1):
                heap[k] = heap[2 * k] + heap[2 * k + 1]

    def leaf(self, k: int) -> tuple[str, list[int], list[int]]:
        """Text, lengths and token counts of a leaf."""
        if self.own[k] is None:
            lengths, counts = self.sizes[:, self.at[k] : self.at[k] + self.n[k]].tolist()
            self.own[k] = self.base[self.starts[k] : self.starts[k] + self.chars[self.width + k]], lengths, counts
        return self.own[k]

    def put(self, k: int, text: str, lengths: list[int], counts: list[int]) -> None:
        """A new leaf, and the sums above it."""
        self.own[k], self.n[k] = (text, lengths, counts), len(lengths)
        node = k + self.width
        more, extra = len(text) - self.chars[node], sum(counts) - self.tokens[node]
        while node:
            self.chars[node] += more
            self.tokens[node] += extra
            node >>= 1

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last with text beyond the end), and where it starts."""
        node, start, chars = 1, 0, self.chars
        at = min(at, chars[1] - 1)
        while node < self.width:
            node *= 2
            if at >= start + chars[node]:
                start += chars[node]
                node += 1
        return node - self.width, start

    def replace(self, start: int, end: int, new: str) -> None:
        """Replace characters ``start`` to ``end`` (cut to the text) by ``new``."""
        n = self.chars[1]
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        behind = AHEAD + self.counter.bpe.longest_special
        first, at = self.find(max(start - behind, 0)) if n else (0, 0)
        last, stop, reach = first, at, end + REACH
        parts, lengths, counts = [], [], []
        while True:
            # Leaves up to ``reach``; the edited text of all of them.
            while last < len(self.own) and (stop < reach or last == first):
                text, more, tokens = self.leaf(last)
                parts.append(text)
                lengths += more
                counts += tokens
                stop, last = stop + len(text), last + 1
            text = "".join(parts)
            edited = text[: start - at] + new + text[end - at :]
            ends = [0, *accumulate(lengths)]
            # The border from which the split is done again: the last that stands far enough before the edit.
            left = max(0, bisect_right(ends, max(start - at - behind, 0)) - 1)
            right, words = self.resplit(edited, ends, left, end - at, len(new) - (end - start), last == len(self.own) or stop == n)
            if words is not None:
                break
            reach = end + 2 * (reach - end) + len(new)
        fresh = self.counter.count(words)
        self.reencoded += len(words)
        lengths, counts = lengths[:left] + list(map(len, words)) + lengths[right:], counts[:left] + fresh + counts[right:]
        self.spread(first, last, edited, lengths, counts)

    def resplit(self, text: str, ends: list[int], left: int, end: int, shift: int, whole: bool) -> tuple[int, list[str] | None]:
        """New pre-tokens from old border ``left`` on, up to the old border (its number is returned) behind ``end`` where both splits agree.

        None if what was read of the text ends before that is certain: a pre-token that reaches its end may go on.
        """
        old = {e + shift: k for k, e in enumerate(ends) if e >= end}
        at, words, behind = ends[left], [], AHEAD + self.counter.bpe.longest_special
        for w in self.counter.bpe.pieces_from(text, at):
            if at in old:
                return old[at], words
            at += len(w)
            if not whole and at + behind >= len(text):
                return 0, None
            words.append(w)
        return (len(ends) - 1, words) if whole else (0, None)

    def spread(self, first: int, last: int, text: str, lengths: list[int], counts: list[int]) -> None:
        """Deal pre-tokens out to leaves ``first`` to ``last``, which they came from; lay the tree out again if they are too many."""
        size = -(-len(lengths) // max(1, last - first))
        if size <= 2 * LEAF:
            at = 0
            for j, k in enumerate(range(first, last)):
                x, y = j * size, (j + 1) * size
                n = sum(lengths[x:y])
                self.put(k, text[at : at + n], lengths[x:y], counts[x:y])
                at += n
            return
        chars, tokens = ([h[self.width + k] for k in range(len(self.n))] for h in (self.chars, self.tokens))
        parts, at = [], 0
        for x in range(0, len(lengths), LEAF):
            n = sum(lengths[x : x + LEAF])
            parts.append((text[at : at + n], lengths[x : x + LEAF], counts[x : x + LEAF]))
            at += n
        # Untouched leaves keep their places in the stored arrays.
        self.own[first:last], self.n[first:last] = parts, [len(p[1]) for p in parts]
        chars[first:last], tokens[first:last] = [len(p[0]) for p in parts], [sum(p[2]) for p in parts]
        self.at, self.starts = ([*x[:first], *[0] * len(parts), *x[last:]] for x in (self.at, self.starts))
        self.build(chars, tokens)

    def stored(self) -> tuple[str, bytes, bytes]:
        """Text, sizes and leaves as the table holds them; stretches without an edit are copied as they are."""
        texts, sizes, k, m = [], [], 0, len(self.own)
        while k < m:
            j = k
            while j < m and self.own[j] is None:
                j += 1
            if j > k:
                texts.append(self.base[self.starts[k] : self.starts[k] + sum(self.chars[self.width + k : self.width + j])])
                sizes.append(self.sizes[:, self.at[k] : self.at[k] + sum(self.n[k:j])])
            else:
                texts.append(self.own[k][0])
                sizes.append(np.array(self.own[k][1:], "<u4").reshape(2, -1))
                j = k + 1
            k = j
        leaves = np.array([self.n, self.chars[self.width : self.width + m], self.tokens[self.width : self.width + m]], "<u4")
        return "".join(texts), (np.concatenate(sizes, 1) if sizes else self.sizes).astype("<u4").tobytes(), leaves.tobytes()

    @classmethod
    def of(cls, text: str, counter: Counter) -> Tree:
        words = counter.bpe.pieces(text)
        sizes = np.array([list(map(len, words)), counter.count(words)], "<u4").reshape(2, -1)
        return cls(text, sizes, laid_out(sizes), counter)


def laid_out(sizes: np.ndarray) -> np.ndarray:
    """Pre-tokens, characters and tokens of each leaf; a text without pre-tokens has one empty leaf."""
    n = sizes.shape[1]
    if not n:
        return np.zeros((3, 1), "<u4")
    at = np.arange(0, n, LEAF)
    return np.concatenate([np.diff(np.append(at, n))[None], np.add.reduceat(sizes.astype(np.int64), at, 1)]).astype("<u4")


def trees(docs: DataFrame, path: str, *, text_col: str = "text", chunk: int = 1_000_000) -> DataFrame:
    """``docs`` with the tree of each whole text (columns TREE): the only time that a text is split as a whole.

    Null and empty texts have an empty tree; rows are independent, so ties and repeats need no rule, and an empty table gives an empty one; a
    very long text is one row of its own chunk. Raises if ``docs`` has a column of TREE already.
    """
    names = [c.split()[0] for c in TREE.split(", ")]
    if clash := set(names) & set(docs.columns):
        raise ValueError(f"docs already has {sorted(clash)}")

    def run(batches):
        counter = Counter.load(path)
        for b in slices(batches):
            texts, out = strings(b, text_col), []
            for at, end in chunks(texts, chunk):
                split = [counter.bpe.pieces(x) for x in texts[at:end]]
                flat = [w for p in split for w in p]
                cuts = np.cumsum([0, *map(len, split)]).tolist()
                sizes = np.array([list(map(len, flat)), counter.count(flat)], "<u4").reshape(2, -1)
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    own = sizes[:, x:y]
                    out.append((own.tobytes(), (leaves := laid_out(own)).tobytes(), y - x, int(leaves[2].sum())))
            added = [pa.array([r[k] for r in out], pa.binary() if k < 2 else pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], [*b.schema.names, *names])

    return docs.mapInArrow(run, added_schema(docs.schema, TREE))


def added_schema(schema: StructType, more: str) -> StructType:
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])


EDIT = "array<struct<seq:long,start:long,end:long,new:string>>"


def edit(kept: DataFrame, edits_col: str, path: str, *, text_col: str = "text") -> DataFrame:
    """Rows of :func:`trees` (or of this function) with the edits of a column of type EDIT made: text and tree follow them.

    Adds n_before and n_reencoded; drops the column of edits; other columns stay. Edits apply by seq, then start, end,
    new; each counts characters of the text as the one before left it; places beyond the text are cut to it, null places are 0, a null ``new`` is
    empty, null edits are none. Repeated rows are edited alike. A null text stays null unless edited.
    """
    rows = kept.withColumn(edits_col, F.col(edits_col).cast(EDIT))
    schema = rows.drop(edits_col).schema
    columns = schema.names

    def run(batches):
        counter = Counter.load(path)
        for b in slices(batches):
            of = {n: b.column(b.schema.get_field_index(n)) for n in b.schema.names}
            texts, sizes, leaves, edits = (of[n].to_pylist() for n in (text_col, "sizes", "leaves", edits_col))
            tokens, pretokens, redone = of["n_tokens"].to_pylist(), of["n_pretokens"].to_pylist(), [0] * b.num_rows
            for k, todo in enumerate(edits):
                if todo:
                    tree = Tree(texts[k] or "", np.frombuffer(sizes[k], "<u4").reshape(2, -1), np.frombuffer(leaves[k], "<u4").reshape(3, -1), counter)
                    for e in sorted(todo, key=lambda e: (e["seq"] or 0, e["start"] or 0, e["end"] or 0, e["new"] or "")):
                        tree.replace(e["start"] or 0, e["end"] or 0, e["new"] or "")
                    texts[k], sizes[k], leaves[k] = tree.stored()
                    tokens[k], pretokens[k], redone[k] = tree.tokens[1], sum(tree.n), tree.reencoded
            new = {text_col: pa.array(texts, pa.string()), "sizes": pa.array(sizes, pa.binary()), "leaves": pa.array(leaves, pa.binary()), "n_pretokens": pa.array(pretokens, pa.int64()), "n_tokens": pa.array(tokens, pa.int64())}
            yield pa.RecordBatch.from_arrays([*(new.get(n, of[n]) for n in columns), of["n_tokens"], pa.array(redone, pa.int64())], [*columns, "n_before", "n_reencoded"])

    return rows.mapInArrow(run, added_schema(schema, "n_before long, n_reencoded long"))


def recount(docs: DataFrame, edits_col: str, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_before, n_after, n_pretokens, n_reencoded, edited (the new text): :func:`trees`, then :func:`edit`."""
    kept = trees(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(edits_col).alias("edits")), path)
    out = edit(kept, "edits", path)
    return out.select(F.col("id").alias(id_col), "n_before", F.col("n_tokens").alias("n_after"), "n_pretokens", "n_reencoded", F.coalesce("text", F.lit("")).alias("edited"))


def with_edits(docs: DataFrame, edits: DataFrame, *, id_col: str = "doc_id", out_col: str = "edits") -> DataFrame:
    """``docs`` with the rows of ``edits`` (id, seq, start, end, new) of each document as an array; edits of one document depend on one another, so they stay together.

    Documents without edits have a null array; edits of a null or unknown id are nobody's; repeated documents get the edits each, repeated edits are made as often
    as given; empty tables give documents without edits, or none.
    """
    grouped = edits.groupBy(id_col).agg(F.collect_list(F.struct("seq", "start", "end", "new")).alias(out_col))
    return docs.join(grouped, id_col, "left")


def sample_edits(doc_id: Column, length: Column) -> Column:
    """Three edits anywhere in a text: a word goes in, a stretch goes out, a stretch is replaced."""
    place = lambda k: F.pmod(F.xxhash64(doc_id, F.lit(k)), length + 1)
    edit = lambda seq, start, size, new: F.struct(F.lit(seq).cast("long").alias("seq"), start.cast("long").alias("start"), (start + size).cast("long").alias("end"), F.lit(new).alias("new"))
    return F.array(edit(0, place(0), F.lit(0), " inserted's"), edit(1, place(1), F.pmod(F.xxhash64(doc_id, F.lit(9)), F.lit(40)), ""), edit(2, place(2), F.lit(12), "  new 42\n"))
