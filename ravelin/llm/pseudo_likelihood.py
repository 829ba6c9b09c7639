"""Language-model scoring by masked pseudo-likelihood.

A network sees the words on both sides of a hidden word and predicts it; the sum of the log-probabilities of
all words, each hidden in turn, scores a document. The network predicts one of ``side`` * ``side`` classes, first
a group and then the class within it. The most frequent words of the corpus are classes of their own; the others
share hashed classes, and a word's share within its class comes from the counts of the whole corpus. So the
probabilities are those of words. Vocabulary and network grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm.common import cut, extended, light_batches, slices, table, without
from ravelin.llm.wordhash import WordHasher, mix

#: Places around the hidden word that the network sees.
AROUND = (-2, -1, 1, 2)
BATCH = 4096
#: Words that are scored at once; no result depends on it.
SCORED = 8192
#: Scores of which no sum of exponentials leaves the range of float32.
SAFE = 80.0
#: Blocks in which the weights of a task travel, so that no task adds up whole networks of all others.
BLOCKS = 64
#: The counts of so many words at most go to every task; those of all others meet their words in a join.
SENT = 1 << 17


def side_of(n_words: int) -> int:
    """How many groups, and classes a group, for a corpus of so many words: twice its sixth root."""
    return max(4, int(np.ceil(2 * max(n_words, 1) ** (1 / 6))))


def known_of(size: int) -> int:
    """How many of ``size`` classes are words of their own."""
    return size - size // 8


def _exponentials(x: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """The exponentials of each row of scores, in their place, and the sum of each row; scores beyond SAFE are lowered by their row's greatest."""
    if not bound < SAFE:
        x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], x.dtype)


def _chosen(x: np.ndarray, at: np.ndarray, bound: float) -> np.ndarray:
    """The log-probability of the choice ``at`` in each row of scores, none of which is greater than ``bound`` in size."""
    if not bound < SAFE:
        x -= x.max(1, keepdims=True)
        bound = 0.0
    own = x[np.arange(len(x)), at]
    return own - np.log(_exponentials(x, bound)[1])


def _missed(x: np.ndarray, at: np.ndarray, bound: float) -> np.ndarray:
    """One for the choice ``at`` of each row, less the probabilities of all choices."""
    x, sums = _exponentials(x, bound)
    x *= (-1 / sums)[:, None]
    x[np.arange(len(x)), at] += 1
    return x


@dataclass
class Network:
    """Word vectors per place around the hidden word, and weights with biases of the groups and of the classes in each."""

    vectors: np.ndarray  # place, class (the last: beyond the text), dimension
    groups: np.ndarray  # dimension + 1, group
    classes: np.ndarray  # group, dimension + 1, class

    @classmethod
    def new(cls, totals: np.ndarray, side: int, width: int, seed: int = 1) -> Network:
        """Vectors at random; biases such that the network starts from how often each class occurs (``totals``)."""
        rng = np.random.default_rng(seed)
        often = (totals + 0.5).reshape(side, side)
        vectors = rng.normal(0, 0.3, (len(AROUND), side * side + 1, width))
        groups, classes = np.zeros((width + 1, side)), np.zeros((side, width + 1, side))
        groups[-1], classes[:, -1] = np.log(often.sum(1)), np.log(often)
        return cls(*(x.astype(np.float32) for x in (vectors, groups, classes)))

    @property
    def side(self) -> int:
        return self.groups.shape[1]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.vectors, self.groups, self.classes)])

    def like(self, flat: np.ndarray) -> Network:
        parts, at = [], 0
        for x in (self.vectors, self.groups, self.classes):
            parts.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Network(*parts)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        total = self.vectors[0].take(context[0], 0)
        for place in range(1, len(AROUND)):
            total += self.vectors[place].take(context[place], 0)
        return np.tanh(total, out=total)

    def _bounds(self) -> tuple[float, float]:
        """What no score of a group, and none of a class, can exceed in size, as nothing hidden exceeds one."""
        return float(np.abs(self.groups).sum(0).max()), float(np.abs(self.classes).sum(1).max())

    def _parts(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """An order in which the rows of a group are neighbours; in it, group and member of each; each group that occurs, with its first row and the one behind its last."""
        group = target // self.side
        by = np.argsort(group.astype(np.uint16), kind="stable")
        group = group[by]
        edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(by) else np.zeros(1, np.int64)
        parts = list(zip(group[edges[:-1]].tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        return by, group, target[by] - group * self.side, parts

    def _scores(self, with_one: np.ndarray, parts: list[tuple[int, int, int]]) -> np.ndarray:
        """The scores of the classes in each row's group."""
        out = np.empty((len(with_one), self.side), with_one.dtype)
        for k, lo, hi in parts:
            np.matmul(with_one[lo:hi], self.classes[k], out=out[lo:hi])
        return out

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        by, group, member, parts = self._parts(target)
        h = self.hidden(context[:, by])
        h = np.concatenate([h, np.ones((len(h), 1), np.float32)], 1)
        ends = self._bounds()
        total = np.empty(len(h), np.float32)
        total[by] = _chosen(h @ self.groups, group, ends[0]) + _chosen(self._scores(h, parts), member, ends[1])
        return total

    def learn(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One step of gradient ascent on a batch, each parameter's step divided by the root of how often the batch uses it."""
        by, group, member, parts = self._parts(target)
        context = context[:, by]
        h = self.hidden(context)
        with_one = np.concatenate([h, np.ones((len(h), 1), np.float32)], 1)
        ends = self._bounds()
        gain = _missed(with_one @ self.groups, group, ends[0])
        back = gain @ self.groups[:-1].T
        part = _missed(self._scores(with_one, parts), member, ends[1])
        for k, lo, hi in parts:
            back[lo:hi] += part[lo:hi] @ self.classes[k, :-1].T
            self.classes[k] += float(rate / np.sqrt(hi - lo)) * (with_one[lo:hi].T @ part[lo:hi])
        self.groups += float(rate / np.sqrt(len(h))) * (with_one.T @ gain)
        back *= 1 - h * h
        for place in range(len(AROUND)):
            _step(self.vectors[place], context[place], back, rate)


def _step(rows: np.ndarray, at: np.ndarray, gain: np.ndarray, rate: float) -> None:
    by = np.argsort(at.astype(np.uint16) if len(rows) <= 1 << 16 else at, kind="stable")
    at = at[by]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    n = np.diff(np.append(first, len(at)))
    rows[at[first]] += np.add.reduceat(gain.take(by, 0), first, axis=0) * (rate / np.sqrt(n)).astype(np.float32)[:, None]


class Reader:
    """Turns texts into classes and contexts; ``often`` are words by falling frequency, the first of which have classes of their own."""

    def __init__(self, often: np.ndarray, size: int):
        self.hasher, self.size, self.known = WordHasher(), size, min(len(often), known_of(size))
        self.rank = np.argsort(often)
        self.sorted = often[self.rank]
        # hashes are spread evenly: where those with the same first bits begin, a handful at most
        bits = min(max(len(often), 1).bit_length() + 1, 30)
        self.shift = np.uint64(64 - bits)
        self.begin = np.append(np.searchsorted(self.sorted, np.arange(1 << bits, dtype=np.uint64) << self.shift), len(often)).astype(np.int32)
        self.most = int(np.diff(self.begin).max())

    def _places(self, words: np.ndarray) -> np.ndarray:
        """The place of each word in ``often``, or -1."""
        out = np.full(len(words), -1)
        if not len(self.sorted):
            return out
        slot = (words >> self.shift).astype(np.int64)
        at = self.begin.take(slot)
        found = self.sorted.take(at, mode="clip") == words
        out[found] = self.rank.take(at[found])
        left = np.flatnonzero(~found)
        for k in range(1, self.most):
            if not len(left):
                break
            left = left[self.begin[slot[left] + 1] > at[left] + k]
            found = self.sorted[at[left] + k] == words[left]
            out[left[found]] = self.rank[at[left[found]] + k]
            left = left[~found]
        return out

    def classes_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each word, and its place in ``often`` or -1."""
        place = self._places(words)
        rest = np.flatnonzero((place < 0) | (place >= self.known))
        out = place.copy()
        out[rest] = self.known + (mix(words[rest]) % np.uint64(self.size - self.known)).astype(np.int64)
        return out, place

    def contexts(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For each word the classes of those around it; ``size`` beyond its text."""
        gap = max(AROUND)
        at = np.arange(len(classes)) + np.repeat(gap * np.arange(1, len(counts) + 1), counts)
        padded = np.full(len(classes) + gap * (len(counts) + 1), self.size, np.int64)
        padded[at] = classes
        return np.stack([padded.take(at + by) for by in AROUND])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of words and how often a piece of the input has them."""
    hasher = WordHasher()
    for whole in batches:
        for batch in slices(whole, 0, 32 << 20, 1 << 20):
            own, n = np.unique(hasher.words(batch.column(0).to_pylist())[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])


def _class_totals(batches: Iterator[pa.RecordBatch], known: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """From (word, n) to the sums of each class."""
    reader, sums = Reader(known, size), np.zeros(size)
    for batch in batches:
        at, _ = reader.classes_of(batch.column(0).to_numpy().view(np.uint64))
        sums += np.bincount(at, batch.column(1).to_numpy(), size)
    some = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["class", "n"])


def _learned(batches: Iterator[pa.RecordBatch], held, known: np.ndarray, turn: int, turns: int, rate: float) -> Iterator[pa.RecordBatch]:
    """Train a copy of the network on a task's texts; yield its weights times the words it learned from, in blocks."""
    start = held.value
    net, reader, seen = start.like(start.flat()), Reader(known, start.side**2), 0
    for whole in batches:
        for batch in slices(whole, 0):
            words, counts = reader.hasher.words(batch.column(0).to_pylist())
            classes, _ = reader.classes_of(words)
            context = reader.contexts(classes, counts)
            place = np.arange(len(classes)) - np.repeat(np.cumsum(counts) - counts, counts)
            masked = np.flatnonzero(place % turns == turn)
            for i in range(0, len(masked), BATCH):
                at = masked[i : i + BATCH]
                net.learn(context[:, at], classes[at], rate)
            seen += len(masked)
    if seen:
        blocks = np.array_split(net.flat().astype(np.float64) * seen, BLOCKS)
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([float(seen)] * BLOCKS), pa.array([b.astype(np.float32).tobytes() for b in blocks], pa.binary())], ["block", "seen", "weights"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the rows of each block; a task holds one sum per block."""
    sums: dict[int, list] = {}
    for batch in batches:
        for block, seen, weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = np.frombuffer(weights, np.float32).astype(np.float64)
            if block in sums:
                sums[block][0] += seen
                sums[block][1] += own
            else:
                sums[block] = [seen, own]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s for s, _ in sums.values()], pa.float64()), pa.array([w.astype(np.float32).tobytes() for _, w in sums.values()], pa.binary())], ["block", "seen", "weights"])


@dataclass
class Model:
    """The network; frequent words, the first of which have classes of their own; and what makes words of classes."""

    network: Network
    often: np.ndarray
    shares: np.ndarray  # of each of these, the logarithm of its share in its class
    totals: np.ndarray  # of each class, the logarithm of its count
    counts: DataFrame | None  # word, n


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """The ``most`` most frequent words, as (word, n), without sending so many from each partition.

    How many words have each count tells where to cut; of very many words at the cut a share by their hash is looked at.
    """
    often = counts.groupBy("n").agg(F.count("*").alias("words")).toPandas().sort_values("n", ascending=False)
    sums = often["words"].cumsum().to_numpy()
    at = int(np.searchsorted(sums, most))
    if at < len(sums):
        least, ties = int(often["n"].iloc[at]), int(often["words"].iloc[at])
        part = min(1.0, 2 * (most - int(sums[at]) + ties) / ties)
        counts = counts.where((F.col("n") > least) | ((F.col("n") == least) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) <= int(part * (1 << 20)))))
    return counts.orderBy(F.desc("n"), "word").limit(most)


def train(docs: DataFrame, text: str = "text", side: int | None = None, width: int = 16, turns: int = 2, rate: float = 0.1) -> Model:
    """Train on every word of every text.

    Counts of all words of the corpus give the vocabulary: ``side`` ** 2 classes, which by default grow as the cube
    root of the corpus, seven eighths of them words. In each of ``turns`` rounds every task trains a copy of the
    network on its texts, with every ``turns``-th word as the hidden one, so that each word has been hidden once
    after the last round; the copies are averaged, each by the words it learned from. What is gathered grows with the
    number of tasks and is summed by block in the cluster; the driver gets one network.

    Null and empty texts have no words; with none at all the network stays as it started. Repeated rows are learned
    from as often as they occur; ties among the last words of the vocabulary go by their hash. The weights depend on
    how rows lie in partitions, as the copies start anew in each; what is learned from does not. Only ``text`` is read.
    """
    light_batches(docs.sparkSession)
    texts = docs.select(text)
    counts = cut(texts.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    side = side or side_of(counts.agg(F.sum("n")).first()[0] or 0)
    size = side * side
    top = _frequent(counts, max(SENT, known_of(size))).toPandas()
    often, shares = top["word"].to_numpy(np.int64).view(np.uint64), np.log(top["n"].to_numpy(np.float64))
    known = often[: known_of(size)]
    sums = counts.mapInArrow(lambda b: _class_totals(b, known, size), "class long, n double").groupBy("class").agg(F.sum("n").alias("n")).toPandas()
    totals = np.bincount(sums["class"].to_numpy(np.int64), sums["n"].to_numpy(float), size).astype(np.float64)
    net = Network.new(totals, side, width)
    for turn in range(turns):
        held = docs.sparkSession.sparkContext.broadcast(net)
        copies = texts.mapInArrow(lambda b, held=held, turn=turn: _learned(b, held, known, turn, turns, rate), "block int, seen double, weights binary")
        sums = copies.repartition("block").mapInArrow(_summed, "block int, seen double, weights binary").toPandas()
        if len(sums):
            sums = sums.sort_values("block")
            net = net.like(np.concatenate([np.frombuffer(w, np.float32) / s for w, s in zip(sums["weights"], sums["seen"], strict=True)]))
    shares[: len(known)] = 0
    shares[len(known) :] -= np.log(np.maximum(totals, 1))[Reader(known, size).classes_of(often[len(known) :])[0]]
    return Model(net, often, shares, np.log(np.maximum(totals, 1)), counts)


def _rare(batches: Iterator[pa.RecordBatch], often: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """From (th_, text) to (th_, word, k): the words of each text that are not among ``often``, each text once per task."""
    reader, seen = Reader(often, size), set()
    for whole in batches:
        for batch in slices(whole, 1):
            names = batch.column(0).to_pylist()
            new = [k for k, x in enumerate(names) if x not in seen and not seen.add(x)]
            words, counts = reader.hasher.words(batch.column(1).take(pa.array(new, pa.int64())).to_pylist())
            other = reader.classes_of(words)[1] < 0
            of = np.repeat(np.arange(len(new)), counts)[other]
            rare = words[other]
            by = np.lexsort((rare, of))
            of, rare = of[by], rare[by]
            first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (rare[1:] != rare[:-1])])) if len(of) else of
            n = np.diff(np.append(first, len(of)))
            keys = np.array([names[k] for k in new], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys[of[first]]), pa.array(rare[first].view(np.int64)), pa.array(n.astype(np.int64))], ["th_", "word", "k"])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with n_words, log_likelihood (the sum over all words, each hidden in turn) and mean_log.

    A word without a class of its own gets the probability of its class times its share in it, by the counts of the
    corpus; a word that the corpus has once or never counts as one. The counts of the SENT most frequent words go to
    every task, all others meet the words in a join, equal texts once a task. Null and empty texts have no words, 0.0 and a null mean. One row per input row; columns of these names
    are replaced; rows are independent, so ties, repeated rows and null ids need no rule. Words are runs of bytes other
    than blanks, A-Z lower-cased; texts are read whole.
    """
    light_batches(docs.sparkSession)
    docs = without(docs, "n_words", "log_likelihood", "mean_log", "th_", "net_")
    keyed = docs.withColumn("th_", F.xxhash64(text))
    at = keyed.columns.index(text)
    size = model.network.side**2
    held = docs.sparkSession.sparkContext.broadcast(replace(model, counts=None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        reader, shares = Reader(own.often, size), np.append(own.shares, 0.0)
        for whole in batches:
            for batch in slices(whole, at):
                words, counts = reader.hasher.words(batch.column(at).to_pylist())
                classes, place = reader.classes_of(words)
                context = reader.contexts(classes, counts)
                logs = np.where(place >= 0, shares[place], -own.totals[classes])
                for i in range(0, len(classes), SCORED):
                    logs[i : i + SCORED] += own.network.log_probability(context[:, i : i + SCORED], classes[i : i + SCORED])
                sums = np.bincount(np.repeat(np.arange(len(counts)), counts), logs, len(counts)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts), pa.array(sums)], [*batch.schema.names, "n_words", "net_"])

    scored = keyed.mapInArrow(run, extended(keyed, n_words=T.LongType(), net_=T.DoubleType()))
    rare = keyed.where(F.col(text).isNotNull()).select("th_", text).mapInArrow(lambda b: _rare(b, held.value.often, size), "th_ long, word long, k long")
    met = rare.join(model.counts.where("n > 1"), "word").groupBy("word", "th_").agg((F.max("k") * F.log(F.max("n").cast("double"))).alias("share"))
    shares = met.groupBy("th_").agg(F.sum("share").alias("share_"))
    total = F.col("net_") + F.coalesce("share_", F.lit(0.0))
    out = scored.join(shares, "th_", "left").select(*docs.columns, "n_words", total.alias("log_likelihood"))
    return out.withColumn("mean_log", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pseudo-likelihood of every document under a network trained on all of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs)).select("doc_id", "n_words", F.round("log_likelihood", 2).alias("log_likelihood"), F.round("mean_log", 4).alias("mean_log"))
