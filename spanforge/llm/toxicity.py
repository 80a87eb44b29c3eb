"""Toxicity of deobfuscated texts.

Noisy channel: what an author meant is a string of letters; the channel swaps letters for look-alikes,
repeats them, or spaces words out. A stretch that may be disguised becomes a lattice of readings per character, and
an exact Viterbi search under a character trigram model of the whole corpus picks the likeliest one, whatever the
stretch's length. A reading that the model finds no likelier than random letters (keys, numbers, rulers) is not taken. The
restored text is then scored by words and word beginnings that the labelled rows tie to toxicity.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import chunks, drop_saved, map_batches, saved, slices, strings

#: Letters that a look-alike may stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "*": "aeiou"}
#: Costs in nats of the channel: a swapped letter, a look-alike that stands for itself, a dropped repeat in a run of three or more and in one of two, a third letter in a row that is meant, a dropped separator, a separator between words.
SWAP, ITSELF, DROP, TWICE, KEEP, JOIN, BREAK = 1.5, 4.0, 0.3, 2.0, 2.0, 0.2, 0.7
LETTER = r"[^\W\d_]"
#: Look-alikes that stand for letters wherever they are, and those that do so only before a letter, as they end sentences too.
ANYWHERE, BEFORE = r"[0-9@$€£]", r"[!|+¡*]"
LOOK = r"[0-9@$!|+€£¡*]"
SINGLE = rf"(?:{LETTER}|[0-9@$!])(?!\w)"
#: What gives a token away that may be disguised: a look-alike; a letter three times over; three doubled letters on end. A row of marks is read once, from its first one.
MARK = re.compile(rf"{ANYWHERE}|(?<!{BEFORE}){BEFORE}++(?={LETTER})|({LETTER})\1(?:\1|({LETTER})\2({LETTER})\3)")
TOKEN = re.compile(rf"(?:[^\W_]|{LOOK})+")
#: A letter that stands alone between separators, and a row of such letters.
ALONE = re.compile(rf"[ ._\-*]{LETTER}(?=[ ._\-*])")
SPACED = re.compile(rf"{LETTER}(?:[ ._\-*]{SINGLE}){{2,}}")
SEPARATORS = " ._-*"
RUNS = re.compile(r"[\W_]+")
#: Characters of one kind in a row beyond so many say no more; digits are left as they are.
LONG_RUN = re.compile(r"([^\d])\1{4,}")
#: A reading must be likelier than letters drawn evenly from so many, per character.
RANDOM = 26
#: Restored stretches up to this length are remembered.
REMEMBERED = 64
CLASSES = 64
MAX_TRAIN = 20_000
#: A feature is a sure sign if at least this share of the rows that have it is toxic.
SURE = 0.85


def letter_class(c: str) -> int:
    """0 border, 1 to 26 a to z, 27 to 60 Latin letters with marks, 61 other letters, 62 digits, 63 the rest."""
    if "a" <= c <= "z":
        return ord(c) - 96
    if 0xDF <= (k := ord(c)) <= 0xFF and k != 0xF7:
        return 27 + k - 0xDF
    return 61 if c.isalpha() else 62 if c.isdigit() else 0 if c.isspace() else 63


TABLE = np.array([letter_class(chr(k).lower()[0]) for k in range(0x250)], np.int64)


def trigram_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """Counts of class trigrams over every whole text, summed on the executors to at most 64^3 rows."""
    def count(batches):
        total = np.zeros(CLASSES**3, np.int64)
        for b in slices(batches):
            texts = strings(b, "text")
            for at, end in chunks(texts):
                # Two spaces between texts: no trigram of letters spans two of them.
                codes = np.frombuffer(f" {'  '.join(texts[at:end])} ".encode("utf-32-le"), "<u4")
                k = np.where(codes < len(TABLE), TABLE[np.minimum(codes, len(TABLE) - 1)], 61)
                if len(k) > 2:
                    total += np.bincount((k[:-2] * CLASSES + k[1:-1]) * CLASSES + k[2:], minlength=CLASSES**3)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    out = np.zeros(CLASSES**3)
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out[rows["gram"].to_numpy()] = rows["n"].to_numpy()
    return out


class Channel:
    """The character model and the search over lattices."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(CLASSES, CLASSES, CLASSES)
        two = c.sum(0) + 0.05
        low = two / two.sum(1, keepdims=True)
        self.cost = (-np.log((c + 8 * low[None]) / (c.sum(2, keepdims=True) + 8))).astype(np.float32)
        self.flat: list[float] = []
        self.known: dict[tuple[str, bool], str] = {}

    def __getstate__(self):
        return {"cost": self.cost, "flat": [], "known": {}}

    def word(self, stretch: str, spaced: bool) -> str:
        """The reading of one stretch; itself if it is one token whose likeliest reading is no likelier than random letters."""
        stretch = LONG_RUN.sub(lambda m: m[0][:4], stretch)
        key = stretch, spaced
        if (out := self.known.get(key)) is None:
            _, out = self.viterbi(stretch, spaced)
            if not spaced and self.plain(out) > math.log(RANDOM) * (len(out) + 1):
                out = stretch
            if len(stretch) <= REMEMBERED:
                if len(self.known) > 50_000:
                    self.known.clear()
                self.known[key] = out
        return out

    def plain(self, s: str) -> float:
        """Cost of a string under the character model, borders at both ends."""
        self.flat = self.flat or self.cost.ravel().tolist()
        k = [0, 0, *map(letter_class, s), 0]
        return sum(self.flat[(a * CLASSES + b) * CLASSES + c] for a, b, c in zip(k, k[1:], k[2:], strict=False))

    @staticmethod
    def lattice(s: str, spaced: bool) -> list[list[tuple[str, float]]]:
        """The readings of each character with their costs."""
        out = []
        for k, c in enumerate(s):
            if spaced and k % 2:
                out.append([("", JOIN), (" ", BREAK)])
            elif c.isalpha():
                out.append([(c, 0.0)])
            else:
                out.append([(x, SWAP) for x in LOOKS.get(c, "")] + ([("", SWAP)] if c not in "0123456789" else []) + [(c, ITSELF)])
        return out

    def viterbi(self, s: str, spaced: bool = False) -> tuple[float, str]:
        """The cheapest path through the lattice of ``s`` and its cost.

        A state is the last two characters read, all that costs depend on; every state is kept, and they are few: as many as
        two characters have readings.
        """
        self.flat = self.flat or self.cost.ravel().tolist()
        flat, n, classes = self.flat, len(s), {"": 0}
        best: dict[tuple[str, str], tuple[float, tuple | None]] = {("", ""): (0.0, None)}
        for k, readings in enumerate(self.lattice(s, spaced)):
            again = k > 0 and s[k - 1] == s[k]
            run = again and (k > 1 and s[k - 2] == s[k] or k + 1 < n and s[k + 1] == s[k])
            new: dict[tuple[str, str], tuple[float, tuple | None]] = {}
            for x, extra in readings:
                if x not in classes:
                    classes[x] = letter_class(x)
                t, drop = classes[x], (DROP if run else TWICE) + extra
                for (a, b), (z, path) in best.items():
                    if x:
                        v = z + extra + flat[(classes[a] * CLASSES + classes[b]) * CLASSES + t] + (KEEP if a == b == x else 0.0)
                        state = b, x
                        if state not in new or v < new[state][0]:
                            new[state] = v, (path, x)
                        if not (again and b == x):
                            continue
                        v = z + drop
                    else:
                        v = z + extra
                    state = a, b
                    if state not in new or v < new[state][0]:
                        new[state] = v, path
            best = new
        cost, path = min(((z + flat[(classes[a] * CLASSES + classes[b]) * CLASSES], path) for (a, b), (z, path) in best.items()), key=lambda e: e[0])
        out = []
        while path:
            path, x = path
            out.append(x)
        return cost, "".join(reversed(out))

    def text(self, text: str) -> str:
        """Lower case, disguised stretches restored, everything but letters and digits a single space."""
        low, out, at = text.lower(), [], 0
        for start, end, spaced in suspects(low):
            out += [low[at:start], self.word(low[start:end], spaced)]
            at = end
        out.append(low[at:])
        return " " + RUNS.sub(" ", "".join(out)).strip() + " "


def tokens(low: str) -> list[tuple[int, int, bool]]:
    """Start and end of the tokens with a mark and a letter; each is looked at once."""
    out, at = [], 0
    while m := MARK.search(low, at):
        start = m.start()
        while start > at and (low[start - 1].isalnum() or low[start - 1] in LOOKS):
            start -= 1
        at = TOKEN.match(low, start).end()
        if any(map(str.isalpha, low[start:at])):
            out.append((start, at, False))
    return out


def rows(low: str) -> list[tuple[int, int, bool]]:
    """Start and end of the rows of letters that stand alone."""
    out, at = [], 0
    while m := ALONE.search(low, at):
        start = m.start() + 1
        # The letter before it may begin the row, where no separator stands before that one.
        if start - 2 >= at and low[start - 2].isalpha() and not (start > 2 and (low[start - 3].isalnum() or low[start - 3] == "_")):
            start -= 2
        if found := SPACED.match(low, start):
            out.append((start, found.end(), True))
        at = found.end() if found else m.end()
    return out


def suspects(low: str) -> list[tuple[int, int, bool]]:
    """Stretches of a lower-case text that may be disguised, in order; of two that overlap the first, then the longer one."""
    out, last = [], 0
    for start, end, spaced in sorted(tokens(low) + rows(low), key=lambda x: (x[0], -x[1])):
        if start >= last:
            out.append((start, end, spaced))
            last = end
    return out


def features(restored: str) -> set[str]:
    """Words and beginnings of words (3 to 8 letters), each with the space before it."""
    out: set[str] = set()
    for w in set(restored.split()):
        out.add(f" {w} ")
        for n in range(3, 9):
            if len(w) > n:
                out.add(f" {w[:n]}")
    return out


class Model:
    """Selected features, found with one automaton in the restored text.

    Each has a weight in a logistic model of all of them, and the share of toxic rows among those that
    have it (the lower end of its Wilson interval), so that one sure sign is enough.
    """

    def __init__(self, channel: Channel, weights: dict[str, tuple[float, float]], bias: float):
        self.channel, self.weights, self.bias, self.machine = channel, weights, bias, None

    def __getstate__(self):
        return self.__dict__ | {"machine": None}

    def score(self, text: str) -> float:
        if self.machine is None:
            self.machine = ahocorasick.Automaton()
            for k, v in self.weights.items():
                self.machine.add_word(k, k)
            self.machine.make_automaton()
        z, sure = self.bias, 0.0
        if self.weights:
            for k in {k for _, k in self.machine.iter(self.channel.text(text))}:
                weight, share = self.weights[k]
                z, sure = z + weight, max(sure, share if share >= SURE else 0.0)
        return max(sure, 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))


def held_out(doc_id: object) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    """Fit channel and classifier.

    The character model counts every text. The classifier learns from at most ``max_train`` labelled rows
    (the documented bound; those of lowest hash) whose crc32(id) mod 5 is not 0; features are counted per
    class on the executors, and those that lean to the toxic rows come to the driver: as many as the bounded sample has. Null labels and ids
    are left out, repeated label rows count once (1 wins), of rows with one id the least text is learnt from; without
    both classes every score is the base rate.
    """
    channel = Channel(trigram_counts(docs, text_col))
    ids = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    ids = ids.where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0).orderBy(F.xxhash64("id"), "id").limit(max_train)
    sample = saved(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id").groupBy("id").agg(F.max("y").alias("y"), F.min(F.coalesce("text", F.lit(""))).alias("text")))
    rate = sample.agg(F.count("*"), F.sum("y")).first()
    n, pos = rate[0], rate[1] or 0
    if not 0 < pos < n:
        drop_saved(sample)
        return Model(channel, {}, math.log((pos + 0.5) / (n - pos + 0.5)))

    restored = saved(map_batches(sample, lambda b: {"id": list(range(b.num_rows)), "y": b.column(1), "text": [channel.text(x) for x in strings(b, "text")]}, "id long, y int, text string"))

    def count(batches):
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for b in slices(batches):
            for y, text in zip(b.column(1).to_pylist(), strings(b, "text"), strict=True):
                found[y].update(features(text))
        for y in (0, 1):
            if found[y]:
                zeros = [0] * len(found[y])
                pair = [zeros, list(found[y].values())] if y else [list(found[y].values()), zeros]
                yield pa.RecordBatch.from_arrays([pa.array(list(found[y])), *(pa.array(p, pa.int64()) for p in pair)], ["f", "neg", "pos"])

    # The lower end of the log-odds, two standard errors down.
    p, q = F.col("pos") + 0.5, F.col("neg") + 0.5
    odds = F.log(p / q) - math.log((pos + 1) / (n - pos + 1)) - 2 * F.sqrt(1 / p + 1 / q)
    sums = restored.mapInArrow(count, "f string, neg long, pos long").groupBy("f").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    top = sums.where(F.col("pos") >= 3).withColumn("odds", odds).where(F.col("odds") > math.log(2)).orderBy(F.col("odds").desc(), "f").toPandas()
    names = top["f"].tolist()
    index = {f: k for k, f in enumerate(names)}

    def pick(b: pa.RecordBatch) -> dict[str, object]:
        return {"y": b.column(1), "at": [sorted(index[f] for f in features(x) if f in index) for x in strings(b, "text")]}

    rows = map_batches(restored, pick, "y int, at array<int>").toPandas() if names else None
    if rows is None:
        drop_saved(sample, restored)
        return Model(channel, {}, math.log((pos + 0.5) / (n - pos + 0.5)))
    drop_saved(sample, restored)
    # Sorted, so that the fit does not depend on the order in which tasks end.
    data = sorted((tuple(a), int(y)) for y, a in zip(rows["y"], rows["at"], strict=True))
    weights, bias = logistic(data, len(names))
    return Model(channel, {f: (float(w), wilson(p, q)) for f, w, p, q in zip(names, weights, top["pos"].tolist(), top["neg"].tolist(), strict=True)}, bias)


def wilson(yes: int, no: int, z: float = 2.0) -> float:
    """The lower end of the interval for a share of ``yes``."""
    n = yes + no
    p = yes / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def logistic(data: list[tuple[tuple[int, ...], int]], size: int, steps: int = 300) -> tuple[np.ndarray, float]:
    """Non-negative weights on presence, with a small ridge; plain gradient steps with momentum (Adam)."""
    y = np.array([d[1] for d in data], float)
    row = np.repeat(np.arange(len(data)), [len(d[0]) for d in data])
    col = np.array([k for d in data for k in d[0]], int)
    w, b = np.zeros(size), math.log(y.mean() / (1 - y.mean()))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(row, w[col], len(data))
        e = 1 / (1 + np.exp(-z)) - y
        g = np.append(np.bincount(col, e[row], size) + 0.003 * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = np.maximum(0, w - step[:-1]), b - step[-1]
    return w, float(b)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row's whole text; null is the empty text, repeats score alike, other columns are ignored.

    A very long text costs time in proportion to its length; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = {"bigint": "long"}.get(k := docs.schema[id_col].dataType.simpleString(), k)
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), lambda b: {"id": b.column(0), "score": [shared.value.score(x) for x in strings(b, "text")]}, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose text scores below ``threshold``, all columns as they are, whatever their names.

    A null text is the empty one and scores by the bias; repeated rows stay or go together; a very long text is read whole; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for b in slices(batches):
            yield b.filter(pa.array([shared.value.score(x) < threshold for x in strings(b, text_col)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
