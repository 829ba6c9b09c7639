"""Toxicity from confirmed examples and unlabelled text, by non-negative positive-unlabelled learning.

A linear classifier over words and word stems minimises prior * E+[l(f)] + max(0, E[l(-f)] - prior * E+[l(-f)]) with
the logistic loss l: E+ is the mean over confirmed toxic texts and E that over all texts, from which the share of the
toxic ones, the class prior, is taken off. A bracket below zero is an overfit, and steps lead back up from there.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm.common import cut, extended, labelled_sample, light_batches, slices, table, without

#: Stems are the first so many letters of a word; the whole word is one feature more.
STEMS = (3, 4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    return [f"{word}$", *(word[:k] for k in STEMS if len(word) >= k)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text) to (feature, n): the texts that have it, summed within a task."""
    n: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            n.update({f for w in set(_WORD.findall((text or "").lower())) for f in features(w)})
    yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["feature", "n"])


class Reader(dict):
    """Numbers words as they come and keeps which known features each has; forgets all when it holds ``most`` words."""

    def __init__(self, known: dict[str, int], most: int = 300_000):
        self.known, self.most = known, most
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.has, self.ends = array("i"), array("i", [0])

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.has.extend([k for f in features(word) if (k := self.known.get(f)) is not None])
        self.ends.append(len(self.has))
        return n

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The known features of each text, each once and ascending, text after text, and how many each text has."""
        if len(self) > self.most:
            self.reset()
        words = [[self[w] for w in set(_WORD.findall((t or "").lower()))] for t in texts]
        of = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        words = np.fromiter((n for w in words for n in w), np.int64, len(of))
        has, ends = np.array(self.has, np.int64), np.array(self.ends, np.int64)
        n = ends[words + 1] - ends[words]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - ends[words], n)
        size = max(len(self.known), 1)
        keys = np.unique(np.repeat(of, n) * size + has[at])
        return keys % size, np.bincount(keys // size, minlength=len(texts))


def _cells(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """``ids`` as one binary value of 16-bit numbers a text."""
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(np.concatenate([[0], 2 * np.cumsum(counts)]).astype(np.int32).tobytes()), pa.py_buffer(ids.astype(np.uint16).tobytes())])


def _opened(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint16).astype(np.int64), np.array([len(v) // 2 for v in values], np.int64)


def _read(batches: Iterator[pa.RecordBatch], at: int, known: dict[str, int]) -> Iterator[pa.RecordBatch]:
    reader = Reader(known)
    for whole in batches:
        for batch in slices(whole, at):
            yield batch.set_column(at, "has", _cells(*reader.read(batch.column(at).to_pylist())))


def _sums(ids: np.ndarray, counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Of ``values``, one for each id, the sum over each text."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def says(ids: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The log-odds of texts; the last weight is the constant."""
    return _sums(ids, counts, weights[ids]) + weights[-1]


def share(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def negative(ids: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Over some texts: their number, the loss of calling all of them not toxic, and its gradient."""
    odds = says(ids, counts, weights)
    p = share(odds)
    gradient = np.bincount(ids, np.repeat(p, counts), len(weights))
    gradient[-1] = p.sum()
    return np.concatenate([[len(counts), np.logaddexp(0, odds).sum()], gradient])


def fit(ids: np.ndarray, counts: np.ndarray, prior: float, pool: Callable[[np.ndarray], np.ndarray], usual: np.ndarray, passes: int = 24, ridge: float = 1e-3, back: float = 1.0, bend: float = 0.01) -> np.ndarray:
    """Weights of the least non-negative risk; confirmed texts as ``ids`` and ``counts``.

    ``pool(weights)`` is ``negative`` over all texts; it is called at most ``passes`` times. ``usual`` is the share of
    all texts that have each feature, by which steps are scaled. A bracket under zero counts ``back`` times its size, so
    steps lead up again; within ``bend`` of zero the turn is rounded. A step of a limited-memory quasi-Newton method is
    shortened until the risk falls.
    """
    size = len(usual) + 1
    curve = np.append(usual, 1.0) * prior * (1 - prior) + ridge
    loose = np.append(np.full(len(usual), ridge), 0.0)
    has = np.append(np.bincount(ids, minlength=len(usual)) / len(counts), 1.0)

    def risk(w: np.ndarray) -> tuple[float, np.ndarray]:
        total, own = pool(w), negative(ids, counts, w)
        own = own[1:] / len(counts)
        bracket, *rest = total[1:] / total[0] - prior * own
        side = 1.0 if bracket > 0 else back
        size = np.hypot(bracket, bend)
        positive = prior * (own[0] - has @ w)  # l(f) = l(-f) - f
        return positive + side * size + loose @ w**2 / 2, prior * (own[1:] - has) + side * bracket / size * np.array(rest) + loose * w

    w = np.zeros(size)
    w[-1] = np.log(prior / (1 - prior))
    value, slope = risk(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    scale = 1.0
    for _ in range(passes - 1):
        way, held = slope.copy(), []
        for s, y in reversed(steps):
            held.append(s @ way / (s @ y))
            way -= held[-1] * y
        way /= curve
        for (s, y), a in zip(steps, reversed(held), strict=True):
            way += s * (a - y @ way / (s @ y))
        way *= min(1.0, 4 / max(np.abs(way).max(), 1e-12))
        new, bent = risk(w - scale * way)
        if new > value - 1e-4 * scale * (slope @ way):
            scale /= 4
            continue
        s, y = -scale * way, bent - slope
        steps = ([*steps, (s, y)] if s @ y > 1e-12 else steps)[-8:]
        done = value - new < 1e-6
        w, value, slope, scale = w + s, new, bent, min(1.0, 4 * scale)
        if done:
            break
    return w


def calibration(odds: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make log-odds those of ``toxic``, with targets a little off 0 and 1.

    (1, 0) where fewer than five rows are of one kind, or where the odds would have to be turned around.
    """
    n = toxic.sum()
    if not 5 <= n <= len(toxic) - 5:
        return 1.0, 0.0
    y = np.where(toxic > 0, (n + 1) / (n + 2), 1 / (len(toxic) - n + 2))
    x, w = np.stack([odds, np.ones(len(odds))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = share(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (y - p))
        w += step * min(1.0, 2 / np.abs(step).max())
    return (float(w[0]), float(w[1])) if w[0] > 0 and np.isfinite(w).all() else (1.0, 0.0)


@dataclass
class Model:
    known: dict[str, int]
    weights: np.ndarray


def _pass(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """From (has) to (k, v): ``negative`` of the texts, summed within a task, without its zeros."""
    weights, total = held.value, 0.0
    for batch in batches:
        total = total + negative(*_opened(batch.column(0)), weights)
    if np.ndim(total):
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["k", "v"])


def _chosen(batches: Iterator[pa.RecordBatch], at: int, new: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Column ``at`` with the features whose ``new`` number is not negative, under that number."""
    for batch in batches:
        ids, counts = _opened(batch.column(at))
        keep = new[ids] >= 0
        yield batch.set_column(at, "has", _cells(new[ids][keep], _sums(ids, counts, keep.astype(float)).round().astype(np.int64)))


def learn(docs: DataFrame, labels: DataFrame, target: str = "toxic", max_rows: int = 4000, max_features: int = 1 << 16, prior: float | None = None, apart: float = 4.0, **how) -> tuple[Model | None, DataFrame | None]:
    """Learn from at most ``max_rows`` documents that ``labels`` confirms, and from the texts of all documents.

    ``prior``, the share of toxic documents, is by default that of the labelled ids. Candidates are the features of at
    least three confirmed texts, at most ``max_features`` (65,536 or fewer), the most frequent first; those stay whose
    frequency differs from that in all texts by ``apart`` standard deviations. The texts of all documents are read
    once; their features are checkpointed, and each step is a pass over them in which a task adds up what its rows say,
    so the driver holds the features of the confirmed rows and sums as long as there are features. A fifth of the
    labelled ids, told by a hash, confirms nothing: at most ``max_rows`` of them, of both kinds, calibrate the odds; with
    fewer than five of a kind the constant is set so that the mean score is the prior.

    Returns the model, and the documents with ``has`` for ``score_features``; both None where nothing is confirmed.
    Confirmed rows with equal id and text count once; ids labelled both ways alike have no label; null ids have none.
    Null and empty texts are texts without features. Very long texts are read whole.
    """
    spark = docs.sparkSession
    light_batches(spark)
    docs = without(docs, "has")
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("double").alias("t")).where("doc_id IS NOT NULL AND t IS NOT NULL").groupBy("doc_id").agg(F.avg("t").alias("t")).where("t <> 0.5")
    said = told.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("t") > 0.5).cast("long")), F.lit(0)).alias("toxic")).first()
    if not said["toxic"]:
        return None, None
    prior = float(np.clip(said["toxic"] / said["n"], 1e-4, 0.5)) if prior is None else prior
    apart_ = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5)) == 0
    own = labelled_sample(docs.select("doc_id", "text"), told.where(~apart_ & (F.col("t") > 0.5)), "t", max_rows)
    own = cut(own.select("text", "row_").dropDuplicates(["row_"]).orderBy("row_").limit(max_rows).select("text"))
    found = own.mapInArrow(_counted, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n")).where("n >= 3").orderBy(F.desc("n"), "feature").limit(max_features).toPandas()
    known = {f: k for k, f in enumerate(found["feature"])}
    ids, counts = _opened(pa.array(own.mapInArrow(lambda b: _read(b, 0, known), "has binary").toPandas()["has"], pa.binary()))
    if not len(counts):
        return None, None
    at, schema = docs.columns.index("text"), T.StructType([T.StructField("has", T.BinaryType()) if f.name == "text" else f for f in docs.schema.fields])
    pool = cut(docs.mapInArrow(lambda b: _read(b, at, known), schema))

    def passed(pool: DataFrame, weights: np.ndarray) -> np.ndarray:
        held = spark.sparkContext.broadcast(weights)
        sums = pool.select("has").mapInArrow(lambda b: _pass(b, held), "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
        return np.bincount(sums["k"].to_numpy(np.int64), sums["v"].to_numpy(float), len(weights) + 2)

    flat = passed(pool, np.zeros(len(known) + 1))  # at odds of zero every text weighs one half
    usual, among = 2 * flat[2:-1] / flat[0], np.bincount(ids, minlength=len(known)) / len(counts)
    keep = np.abs(among - usual) > apart * np.sqrt(np.maximum(usual, 0.5 / len(counts)) / len(counts))
    new = np.where(keep, np.cumsum(keep) - 1, -1)
    pool = cut(pool.mapInArrow(lambda b: _chosen(b, at, new), pool.schema))
    kept = new[ids] >= 0
    ids, counts = new[ids][kept], _sums(ids, counts, kept.astype(float)).round().astype(np.int64)
    weights = fit(ids, counts, prior, lambda w: passed(pool, w), usual[keep], **how)
    rows = labelled_sample(pool.select("doc_id", "has"), told.where(apart_), "t", max_rows, "has").select("has", "target_", "row_")
    rows = rows.orderBy("row_", "target_").limit(max_rows).toPandas()
    slope, shift = calibration(says(*_opened(pa.array(rows["has"], pa.binary())), weights), rows["target_"].to_numpy(float))
    weights = weights * slope
    weights[-1] += shift
    for _ in range(5 if (slope, shift) == (1.0, 0.0) else 0):  # without calibration: so that the mean score comes to the prior
        total = passed(pool, weights)
        mean = np.clip(total[-1] / total[0], 1e-6, 1 - 1e-6)
        weights[-1] += np.log(prior / (1 - prior)) - np.log(mean / (1 - mean))
    return Model({f: int(new[k]) for f, k in known.items() if keep[k]}, weights), pool


def _scored(batches: Iterator[pa.RecordBatch], at: int, held) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        odds = says(*_opened(batch.column(at)), held.value)
        yield batch.append_column("score", pa.array(np.round(share(odds), 6)))


def score_features(rows: DataFrame, model: Model) -> DataFrame:
    """Rows of ``learn`` or ``with_features`` with their score instead of ``has``."""
    rows = without(rows, "score")
    at, held = rows.columns.index("has"), rows.sparkSession.sparkContext.broadcast(model.weights)
    return rows.mapInArrow(lambda b: _scored(b, at, held), extended(rows, score=T.DoubleType())).drop("has")


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with their score, 0 to 1, null without a model; a column of this name is replaced.

    Null and empty texts, and those without a known feature, get the score of the constant alone. Whole texts are
    read; rows are independent, so ties, repeated rows and null ids need no rule; an empty table stays empty. No shuffle.
    """
    docs = without(docs, "score", "has")
    if model is None:
        return docs.withColumn("score", F.lit(None).cast("double"))
    light_batches(docs.sparkSession)
    named = docs.withColumn("has", F.col(text))
    at, schema = len(docs.columns), T.StructType([*docs.schema.fields, T.StructField("has", T.BinaryType())])
    return score_features(named.mapInArrow(lambda b: _read(b, at, model.known), schema), model)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learned from the labels of three quarters of the ids."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    labels = table(spark, sf_dir, "labels").where(~held_out)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, rows = learn(docs, labels)
    scored = score(docs, None) if model is None else score_features(rows, model)
    score_ = F.coalesce("score", F.lit(0.0))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), score_.alias("score"), (score_ >= 0.3).cast("int").alias("predicted"))
