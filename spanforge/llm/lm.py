"""Document scores from a masked, bidirectional window network, trained in numpy.

Every word is predicted from the two words before and the two after it, never from itself. A word has a bin: the
commonest words one of their own, all others share bins by the level of their count and the end of the word. The network gives
p(bin | both sides) as a softmax over classes of bins and one over the bins of the class, both learnt; corpus counts
give p(word | bin). A document's score is the sum of the logarithms over its words, its pseudo-log-likelihood.

Word counts cover all documents and all words, and are joined to the words of the texts as a table. Training takes
every word of every document as a target, data-parallel: documents are dealt to units by a hash, each unit fits a
copy of the parameters in an order of its own, and copies are averaged. Units, their order and the averages
depend on the rows alone, not on how they are dealt out to tasks.
"""

from __future__ import annotations

import math
import secrets
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import drop_saved, folded_words, saved, slices, strings

#: Classes of single words and of shared bins, and bins of a class.
SINGLE, LEVELS, MEMBERS = 16, 16, 32
CLASSES, BINS = SINGLE + LEVELS, (SINGLE + LEVELS) * MEMBERS
HIDDEN, SIDE = 32, 2
#: One word in so many is a target of a round, from a start that moves on with the rounds: over all rounds every word is one.
STRIDE = 3
#: Targets of a step: a 128th of what a unit has in a round, within these bounds.
ROUNDS, RATE, STEPS, LEAST, BATCH = 3, 0.01, 128, 32, 2048
CHUNK = 16_384
#: Characters of a slice, whose words are numbered on their own; words of a unit of training.
SLICE, UNIT = 1 << 23, 1 << 20


def sliced(docs: DataFrame) -> DataFrame:
    """One row per slice of some texts (id, text): ids, keys, words in each text, the texts in numbers of the slice's words (packed), those words and their counts."""
    kind = docs.schema["id"].dataType.simpleString()

    def row(ids: list, keys: list, parts: list[np.ndarray], number: dict[bytes, int]) -> pa.RecordBatch:
        tokens = np.concatenate(parts)
        lists = [pa.concat_arrays(ids), pa.concat_arrays(keys), pa.array([len(x) for x in parts], pa.int64()), pa.array([w.decode() for w in number], pa.string()), pa.array(np.bincount(tokens, minlength=len(number)), pa.int64())]
        ids, keys, sizes, words, counts = (pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists)
        return pa.RecordBatch.from_arrays([pa.array([secrets.randbits(63)], pa.int64()), ids, keys, sizes, pa.array([zstandard.compress(tokens.tobytes(), 1)], pa.binary()), words, counts], ["slice", "ids", "keys", "sizes", "tokens", "words", "counts"])

    def run(batches):
        ids, keys, parts, size, number = [], [], [], 0, numbers()
        for b in slices(batches, 200):
            texts = strings(b, "text")
            ids.append(b.column(0))
            keys.append(b.column(2))
            parts += [np.fromiter(map(number.__getitem__, w), np.uint32, len(w)) for w in map(folded_words, texts)]
            size += sum(map(len, texts))
            if size >= SLICE:
                yield row(ids, keys, parts, number)
                ids, keys, parts, size, number = [], [], [], 0, numbers()
        if ids:
            yield row(ids, keys, parts, number)

    rows = docs.select("id", "text", F.xxhash64("id", "text").alias("key"))
    return rows.mapInArrow(run, f"slice long, ids array<{kind}>, keys array<long>, sizes array<long>, tokens binary, words array<string>, counts array<long>")


def numbers() -> defaultdict[bytes, int]:
    out: defaultdict[bytes, int] = defaultdict()
    out.default_factory = out.__len__
    return out


def word_counts(parts: DataFrame) -> DataFrame:
    """(word, n) over all slices."""
    return parts.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy(F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("n"))


def binned(counts: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(word, bin, log p(word | bin)) of every counted word, and the words of each bin.

    The driver gets the words of the single bins (a fixed number) and the sums of the bins.
    """
    top = [(r[0], r[1]) for r in counts.orderBy(F.col("n").desc(), "word").limit(SINGLE * MEMBERS).collect()]
    spark = counts.sparkSession
    ranks = spark.createDataFrame([(w, k) for k, (w, _) in enumerate(top)], "word string, rank int")
    # Levels are even steps of log n between 1 and the least count of a single word.
    most = top[-1][1] if top else 1
    level = F.least(F.lit(LEVELS - 1), F.floor(F.log("n") * LEVELS / math.log(most + 1)))
    shared = (SINGLE + level) * MEMBERS + F.pmod(F.xxhash64(F.right("word", F.lit(2))), F.lit(MEMBERS))
    out = counts.join(F.broadcast(ranks), "word", "left").select("word", "n", F.coalesce("rank", shared).cast("int").alias("bin"))
    sums = [(r[0], r[1]) for r in out.groupBy("bin").agg(F.sum("n").alias("mass")).collect()]
    masses = spark.createDataFrame(sums, "bin int, mass long")
    mass = np.zeros(BINS)
    for k, n in sums:
        mass[k] = n
    return out.join(F.broadcast(masses), "bin").select("word", "bin", F.log(F.col("n") / F.col("mass")).cast("float").alias("log")), mass


def coded(docs: DataFrame, unit: int = UNIT) -> tuple[DataFrame, np.ndarray]:
    """Every row of ``docs`` (id, text), packed: ids, words in each text, bins of all words, and per text the sum of log p(word | bin); the words of each bin.

    A packed row is a unit: documents whose key falls to it, in the order of their keys, ``unit`` words on average and at most
    twice as many or one document.
    """
    parts = saved(sliced(docs), "zstd")
    counts = saved(word_counts(parts))
    found, mass = binned(counts)
    # A slice has each word once, so a word has at most one row in as many as a slice has words.
    known = parts.select("slice", F.posexplode("words").alias("place", "word")).join(found, "word").groupBy("slice").agg(F.collect_list(F.struct("place", "bin", "log")).alias("known"))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for b in slices(batches, 1):
            ids, keys, sizes, tokens, known = (b.column(k)[0] for k in range(5))
            tokens, sizes, known = np.frombuffer(zstandard.decompress(tokens.as_py()), np.uint32), sizes.values.to_numpy(), known.values
            n = 0 if known is None else len(known)
            bins, logs = np.zeros(n, np.uint16), np.zeros(n)
            if n:
                place, of, log = (known.field(k).to_numpy() for k in range(3))
                bins[place], logs[place] = of, log
            cuts = np.cumsum([0, *sizes])
            codes = bins[tokens].tobytes()
            member = np.bincount(np.repeat(np.arange(len(sizes)), sizes), logs[tokens], len(sizes))
            yield pa.RecordBatch.from_arrays([ids.values, keys.values, pa.array([codes[2 * x : 2 * y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary()), pa.array(member)], ["id", "key", "codes", "member"])

    rows = parts.select("slice", "ids", "keys", "sizes", "tokens").join(known, "slice", "left").select("ids", "keys", "sizes", "tokens", "known").mapInArrow(run, f"id {kind}, key long, codes binary, member double")
    dealt = rows.withColumn("unit", F.pmod("key", F.lit(max(1, round(mass.sum() / unit))))).repartition("unit").sortWithinPartitions("unit", "key")

    def pack(batches):
        held: list = []
        at, size = None, 0
        for b in slices(batches, 100):
            for k, (u, codes) in enumerate(zip(b.column(4).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if held and (u != at or size + len(codes) > 4 * unit):
                    yield packed(held)
                    held, size = [], 0
                held.append((b.column(0).slice(k, 1), codes, b.column(3)[k].as_py()))
                at, size = u, size + len(codes)
        if held:
            yield packed(held)

    out = saved(dealt.mapInArrow(pack, f"ids array<{kind}>, sizes array<long>, bins binary, member array<double>"), "zstd")
    drop_saved(parts, counts)
    return out, mass


def packed(held: list) -> pa.RecordBatch:
    lists = [pa.concat_arrays([h[0] for h in held]), pa.array([len(h[1]) // 2 for h in held], pa.int64()), pa.array([h[2] for h in held], pa.float64())]
    ids, sizes, member = (pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists)
    return pa.RecordBatch.from_arrays([ids, sizes, pa.array([b"".join([h[1] for h in held])], pa.binary()), member], ["ids", "sizes", "bins", "member"])


class Network:
    """One table per position of the window (bin to hidden units), tanh, a softmax over classes and one over the bins of each class."""

    def __init__(self, flat: np.ndarray | None = None, seed: int = 1):
        shapes = [(2 * SIDE, BINS + 1, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,), (CLASSES, HIDDEN, MEMBERS), (CLASSES, MEMBERS)]
        sizes = [math.prod(s) for s in shapes]
        if flat is None:
            rng = np.random.default_rng(seed)
            flat = np.concatenate([rng.normal(0, 0.1, n) if k in (0, 2, 4) else np.zeros(n) for k, n in enumerate(sizes)])
        self.flat = flat.astype(np.float32)
        cuts = np.cumsum([0, *sizes])
        self.table, self.bias, self.out, self.out_bias, self.inner, self.inner_bias = (self.flat[a:b].reshape(s) for a, b, s in zip(cuts[:-1], cuts[1:], shapes, strict=True))

    @classmethod
    def started(cls, mass: np.ndarray) -> Network:
        """Parameters before any training: biases from the words of each bin, so that the first predictions are their shares."""
        net, shares = cls(), (mass + 0.5).reshape(CLASSES, MEMBERS)
        net.out_bias[:] = np.log(shares.sum(1) / shares.sum())
        net.inner_bias[:] = np.log(shares / shares.sum(1, keepdims=True))
        return net

    def hidden(self, context: np.ndarray) -> np.ndarray:
        h = self.table[0][context[:, 0]]
        for k in range(1, 2 * SIDE):
            h += self.table[k][context[:, k]]
        h += self.bias
        return np.tanh(h, out=h)

    def scores(self, h: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Scores of the classes; scores of the bins of each target's class, in order of classes; that order, h in it, and the stretch of each class."""
        of = (target // MEMBERS).astype(np.uint8)
        order = np.argsort(of, kind="stable")
        cuts = np.cumsum([0, *np.bincount(of, minlength=CLASSES)]).tolist()
        runs = [(c, x, y) for c, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
        hs, inner = h[order], np.empty((len(h), MEMBERS), np.float32)
        for c, x, y in runs:
            np.matmul(hs[x:y], self.inner[c], out=inner[x:y])
            inner[x:y] += self.inner_bias[c]
        return h @ self.out + self.out_bias, inner, order, hs, runs

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log p(bin | window) of each target."""
        outer, inner, order, _, _ = self.scores(self.hidden(context), target)
        rows = np.arange(len(target))
        out = outer[rows, target // MEMBERS] - log_sum(outer)
        out[order] += inner[rows, target[order] % MEMBERS] - log_sum(inner)
        return out

    def fit(self, context: np.ndarray, target: np.ndarray, rate: float, moments: Moments) -> None:
        """One pass over the windows, with steps scaled by running moments of the gradient (Adam)."""
        grad, size = Network(np.zeros_like(self.flat)), min(BATCH, max(LEAST, len(target) // STEPS))
        for at in range(0, len(target), size):
            c, t = context[at : at + size], target[at : at + size]
            rows, h = np.arange(len(t)), self.hidden(c)
            outer, inner, order, hs, runs = self.scores(h, t)
            softmax(outer)
            outer[rows, t // MEMBERS] -= 1
            softmax(inner)
            inner[rows, t[order] % MEMBERS] -= 1
            np.matmul(h.T, outer, out=grad.out)
            grad.out_bias[:] = outer.sum(0)
            grad.inner[:], grad.inner_bias[:] = 0, 0
            deeper = np.empty_like(hs)
            for k, x, y in runs:
                np.matmul(hs[x:y].T, inner[x:y], out=grad.inner[k])
                grad.inner_bias[k] = inner[x:y].sum(0)
                np.matmul(inner[x:y], self.inner[k].T, out=deeper[x:y])
            back = outer @ self.out.T
            back[order] += deeper
            back *= 1 - h * h
            grad.bias[:] = back.sum(0)
            grad.table[:] = 0
            for k in range(2 * SIDE):
                ordered = np.argsort(c[:, k], kind="stable")
                seen = c[ordered, k]
                first = np.flatnonzero(np.append(True, seen[1:] != seen[:-1]))
                grad.table[k][seen[first]] = np.add.reduceat(back[ordered], first)
            grad.flat /= len(t)
            moments.step(self.flat, grad.flat, rate)


class Moments:
    """Running means of a gradient and of its squares."""

    def __init__(self, size: int):
        self.one, self.two, self.n, self.work = np.zeros(size, np.float32), np.zeros(size, np.float32), 0, np.empty(size, np.float32)

    def step(self, flat: np.ndarray, grad: np.ndarray, rate: float) -> None:
        self.n += 1
        self.one *= 0.9
        self.one += np.multiply(grad, 0.1, out=self.work)
        self.two *= 0.99
        grad *= grad
        self.two += np.multiply(grad, 0.01, out=self.work)
        np.sqrt(self.two, out=self.work)
        self.work /= math.sqrt(1 - 0.99**self.n)
        self.work += 1e-8
        np.divide(self.one, self.work, out=self.work)
        self.work *= rate / (1 - 0.9**self.n)
        flat -= self.work


def softmax(z: np.ndarray) -> None:
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)


def log_sum(z: np.ndarray) -> np.ndarray:
    top = z.max(1)
    return top + np.log(np.exp(z - top[:, None]).sum(1))


def windows(bins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and owner of every word of some documents, given end to end; BINS stands beyond a border."""
    pad = SIDE * (len(sizes) + 1)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(bins)) + SIDE * (owner + 1)
    line = np.full(len(bins) + pad, BINS, np.uint16)
    line[at] = bins
    return np.stack([line[at + k] for k in (*range(-SIDE, 0), *range(1, SIDE + 1))], 1), owner


def targets(sizes: np.ndarray, k: int, stride: int) -> np.ndarray:
    """Which words are targets in round ``k``: each place of a text in one round of every ``stride``, whatever its task or neighbours."""
    first = np.cumsum(sizes) - sizes
    return (np.arange(int(sizes.sum())) - np.repeat(first, sizes)) % stride == k % stride


def units(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bins and sizes of each packed row."""
    for b in slices(batches, 1):
        yield np.frombuffer(b.column(b.schema.get_field_index("bins"))[0].as_py(), np.uint16), b.column(b.schema.get_field_index("sizes"))[0].values.to_numpy()


#: Parameters are averaged as whole numbers of 2^-GRID, so that sums do not depend on their order.
GRID = 20
#: Rows of parameters that the driver adds up.
SUMS = 8


def train(packs: DataFrame, mass: np.ndarray, rounds: int = ROUNDS, stride: int = STRIDE) -> Network:
    """Averages of the units' copies after each round, weighted by their words in thousands; at most SUMS partial sums reach the driver."""
    sc = packs.sparkSession.sparkContext
    net = Network.started(mass)
    for k in range(rounds):
        flat, rate = sc.broadcast(net.flat), RATE / (1 + k)

        def fit(batches, flat=flat, rate=rate, k=k):
            sums, n = np.zeros(len(flat.value), np.int64), 0
            for bins, sizes in units(batches):
                context, pick = windows(bins, sizes)[0], np.flatnonzero(targets(sizes, k, stride))
                if len(pick):
                    pick = np.random.default_rng(k).permutation(pick)
                    own, weight = Network(flat.value.copy()), max(1, len(pick) >> 10)
                    own.fit(context[pick], bins[pick], rate, Moments(len(own.flat)))
                    sums, n = sums + np.rint(own.flat.astype(np.float64) * (1 << GRID)).astype(np.int64) * weight, n + weight
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary()), pa.array([n])], ["sums", "n"])

        def add(batches):
            sums, n = 0, 0
            for b in slices(batches, 1):
                sums, n = sums + np.frombuffer(b.column(0)[0].as_py(), np.int64), n + b.column(1)[0].as_py()
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary()), pa.array([n])], ["sums", "n"])

        parts = packs.select("bins", "sizes").mapInArrow(fit, "sums binary, n long").repartition(8 * SUMS).mapInArrow(add, "sums binary, n long").repartition(SUMS).mapInArrow(add, "sums binary, n long").collect()
        flat.unpersist()
        if total := sum(r["n"] for r in parts):
            net = Network(sum(np.frombuffer(r["sums"], np.int64) for r in parts) / (total * float(1 << GRID)))
    return net


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, stride: int = STRIDE) -> DataFrame:
    """Per row: id, n_words, log_likelihood, per_word (null without words), from a model of all of ``docs``.

    Each of ``rounds`` rounds of training takes one word in ``stride`` of every document, from a start that moves on: with
    ``stride`` up to ``rounds`` every word is a target. Null and wordless texts score 0 over no words; repeated rows count in training
    and score alike; other columns are ignored; an empty table gives an empty result; a very long text is a unit of its own.
    """
    found, mass = coded(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    net = train(found, mass, rounds, stride)
    shared = docs.sparkSession.sparkContext.broadcast(net.flat)
    kind = {"bigint": "long"}.get(k := docs.schema[id_col].dataType.simpleString(), k)

    def run(batches):
        model = Network(shared.value)
        for b in slices(batches, 1):
            ids, member = (b.column(b.schema.get_field_index(n))[0].values for n in ("ids", "member"))
            ((bins, sizes),) = units([b])
            context, owner = windows(bins, sizes)
            logs = np.concatenate([model.log_probability(context[k : k + CHUNK], bins[k : k + CHUNK]) for k in range(0, len(bins), CHUNK)] or [np.zeros(0)])
            total = np.bincount(owner, logs, len(sizes)) + member.to_numpy()
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(total, pa.float64()), pa.array(np.where(sizes > 0, total / np.maximum(sizes, 1), 0), pa.float64(), mask=sizes == 0)], ["id", "n_words", "log_likelihood", "per_word"])

    return found.mapInArrow(run, f"id {kind}, n_words long, log_likelihood double, per_word double").withColumnRenamed("id", id_col)
