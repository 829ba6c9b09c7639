"""Quality classification by co-training.

One classifier sees the text, the other the metadata of the page alone: its source and language. Round by round
each passes the unlabelled documents of which it is sure to the other as further training rows. Both views are then
calibrated on labelled rows that neither was trained on, and their evidence is added up to score all documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm.common import bounded, cut, extended, labelled_sample, light_batches, slices, table, without
from ravelin.llm.quality_trees import FEATURES, measures
from ravelin.llm.wordhash import WordHasher

WORD_BINS = 256
#: Places of the sources and of the languages in the metadata view.
META_BINS = (256, 64)
TEXT_WIDTH, META_WIDTH = len(FEATURES) + WORD_BINS, sum(META_BINS)


def text_view(texts: list[str | None], hasher: WordHasher) -> np.ndarray:
    """Document statistics, and the shares (square roots) of words in hashed bins."""
    words, counts = hasher.words(texts)
    of = np.repeat(np.arange(len(texts)), counts)
    bins = np.bincount(of * WORD_BINS + (words % np.uint64(WORD_BINS)).astype(np.int64), minlength=len(texts) * WORD_BINS).reshape(len(texts), WORD_BINS)
    stats = np.array([measures(t)[1] for t in texts]).reshape(-1, len(FEATURES))
    return np.concatenate([stats, np.sqrt(bins / np.maximum(counts, 1)[:, None])], 1)


def meta_places() -> list[Column]:
    """s_ and l_: where source and language, hashed whole, stand in the metadata view; null has a hash of its own."""
    hashed = lambda c: F.xxhash64(F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("")))
    first = F.pmod(hashed("source"), F.lit(META_BINS[0])).alias("s_")
    return [first, (F.pmod(hashed("lang"), F.lit(META_BINS[1])) + META_BINS[0]).alias("l_")]


def meta_view(sources: np.ndarray, langs: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sources), META_WIDTH))
    out[np.arange(len(sources)), sources] = 1
    out[np.arange(len(langs)), langs] = 1
    return out


def _share(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1))], 1)


@dataclass
class Linear:
    """Logistic regression on standardised features, then a calibration of its log-odds."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def standard(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * (self.standard(x) @ self.weights[:-1] + self.weights[-1]) + self.shift


def _newton(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float, more: np.ndarray | float = 0.0, times: float = 1.0) -> np.ndarray:
    """A Newton step on the penalised log-likelihood of rows ``x`` (with a one).

    ``more`` is the gradient of further rows, whose curvature is taken to be that of ``x``: all together ``times`` of it.
    """
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    p = _share(x @ w)
    gain = x.T @ (y - p) + more - penalty * w
    curve = times * ((x * (p * (1 - p))[:, None]).T @ x) + np.diag(penalty + 1e-9)
    step = np.linalg.solve(curve, gain)
    return step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    x = _with_one(x)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        step = _newton(x, y, w, ridge)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float) -> Linear:
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    return Linear(mean, scale, _logistic((x - mean) / scale, y, ridge))


def calibrate(model: Linear, x: np.ndarray, y: np.ndarray) -> Linear:
    """Fit slope and shift of the log-odds to labelled rows; a slope never turns a view around."""
    plain = replace(model, slope=1.0, shift=0.0)
    w = _logistic(plain.odds(x)[:, None], y, ridge=1.0)
    if w[0] <= 0:
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        w = np.array([0.0, np.log(share / (1 - share))])
    return replace(model, slope=float(w[0]), shift=float(w[1]))


@dataclass
class Views:
    text: Linear
    meta: Linear
    prior: float  # log-odds

    def __call__(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, ...]:
        a, b = self.text.odds(text), self.meta.odds(meta)
        return _share(a), _share(b), _share(a + b - self.prior)


def pushes(text: np.ndarray, meta: np.ndarray, senders: list[Linear], now: list[Linear], sure: float) -> np.ndarray:
    """What rows without a label say to both views, each listening to the other.

    For either view and either label: the number of rows of which the other view is ``sure``, and the gradient of
    their log-likelihood under the view's present weights. All in one row of numbers, to be summed over rows.
    """
    own, out = (text, meta), []
    for k in (0, 1):
        told = _share(senders[1 - k].odds(own[1 - k]))
        x = _with_one(now[k].standard(own[k]))
        p = _share(x @ now[k].weights)
        for label, rows in ((0.0, told <= 1 - sure), (1.0, told >= sure)):
            out += [[float(rows.sum())], (label - p[rows]) @ x[rows]]
    return np.concatenate(out)


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, gathered: Callable, rounds: int = 3, steps: int = 3, sure: float = 0.95, ridge: float = 5.0) -> Views:
    """Fit two views of labelled rows (``y``: 0 or 1) and of a pool; every fifth labelled row is kept for calibration.

    ``gathered(senders, now, sure)`` gives the sum of ``pushes`` over the whole pool. In each round both views, as
    calibrated at its start, tell each other the rows they are sure of; ``steps`` Newton steps follow. The rows told
    with a label weigh together at most as much as the labelled rows that have it.
    """
    held = np.arange(len(y)) % 5 == 4
    own, label = (text, meta), y[~held]
    models = [fit_linear(x[~held], label, ridge) for x in own]
    for _ in range(rounds):
        senders = [calibrate(m, x[held], y[held]) for m, x in zip(models, own, strict=True)]
        for _ in range(steps):
            told, at, moved = gathered(senders, models, sure), 0, []
            for k in (0, 1):
                more, weight = 0.0, 0.0
                for c in (0.0, 1.0):
                    n, size = told[at], own[k].shape[1] + 1
                    part = min(1.0, (label == c).sum() / n) if n else 0.0
                    more, weight = more + part * told[at + 1 : at + 1 + size], weight + part * n
                    at += 1 + size
                x = _with_one(models[k].standard(own[k][~held]))
                step = _newton(x, label, models[k].weights, ridge, more, 1 + weight / len(label))
                moved.append(replace(models[k], weights=models[k].weights + step))
            models = moved
    models = [calibrate(m, x[held], y[held]) for m, x in zip(models, own, strict=True)]
    base = np.clip(y[held].mean(), 1e-3, 1 - 1e-3)
    return Views(models[0], models[1], float(np.log(base / (1 - base))))


def _viewed(batches: Iterator[pa.RecordBatch], at: int, kind: type) -> Iterator[pa.RecordBatch]:
    """The text in column ``at`` as its view, in bytes of numbers of ``kind``; other columns stay."""
    hasher = WordHasher()
    for whole in batches:
        for batch in slices(whole, at):
            view = text_view(batch.column(at).to_pylist(), hasher).astype(kind)
            yield batch.set_column(at, "view", pa.array([x.tobytes() for x in view], pa.binary()))


def _gathered(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """From (view, s_, l_) to (k, v): the numbers of ``pushes``, summed within a task."""
    senders, now, sure = held.value
    total = 0.0
    for whole in batches:
        for batch in slices(whole, 0):
            text = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float16).reshape(-1, TEXT_WIDTH).astype(np.float64)
            total = total + pushes(text, meta_view(batch.column(1).to_numpy(), batch.column(2).to_numpy()), senders, now, sure)
    if np.ndim(total):
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "v"])


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", max_rows: int = 5000, **fit) -> Views | None:
    """Fit on at most ``max_rows`` labelled documents and on all documents whose id has no label.

    The features of the latter are computed once and checkpointed; every step is a pass over them in which each task
    adds up what its rows say, so the driver holds the features of the labelled rows and sums of fixed size. Rows with
    equal id and text count once among the labelled, each among the others; null ids have no label. Null and empty
    texts and null metadata have features of their own. None where fewer than ten rows or one class are labelled.
    """
    light_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", *meta_places())
    own = labelled_sample(docs, labels, target, max_rows).select("text", "row_", "target_", "s_", "l_")
    rows = bounded(own.mapInArrow(lambda b: _viewed(b, 0, np.float64), "view binary, row_ long, target_ double, s_ long, l_ long"), max_rows).toPandas()
    y = rows["target_"].to_numpy(float)
    if len(y) < 10 or len(set(y)) < 2:
        return None
    pool = docs.mapInArrow(lambda b: _viewed(b, 1, np.float16), "doc_id long, view binary, s_ long, l_ long")
    pool = cut(pool.join(labels.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_anti").select("view", "s_", "l_"))

    def gathered(senders: list[Linear], now: list[Linear], sure: float) -> np.ndarray:
        held = docs.sparkSession.sparkContext.broadcast((senders, now, sure))
        sums = pool.mapInArrow(lambda b: _gathered(b, held), "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
        return np.bincount(sums["k"].to_numpy(np.int64), sums["v"].to_numpy(float), 2 * (TEXT_WIDTH + 2) + 2 * (META_WIDTH + 2))

    text = np.frombuffer(b"".join(rows["view"]), np.float64).reshape(-1, TEXT_WIDTH)
    return co_train(text, meta_view(rows["s_"].to_numpy(), rows["l_"].to_numpy()), y, gathered, **fit)


def classify(docs: DataFrame, views: Views | None, threshold: float = 0.5) -> DataFrame:
    """``docs`` with p_text, p_meta, score and kept.

    One row per input row; columns of these names are replaced. Null and empty texts and null metadata have views
    of their own and are scored like others; rows are independent, so ties, repeated rows and null ids need no rule.
    Texts are read whole, a very long one alone in its slice. An empty table stays empty.
    Without a model the scores are null and every document is kept.
    """
    light_batches(docs.sparkSession)
    docs = without(docs, "p_text", "p_meta", "score", "kept", "s_", "l_")
    at = docs.columns.index("text")
    held = docs.sparkSession.sparkContext.broadcast(views)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, model = WordHasher(), held.value
        for whole in batches:
            for batch in slices(whole, at):
                if model is None:
                    own = [pa.nulls(batch.num_rows, pa.float64())] * 3
                    kept = pa.array(np.ones(batch.num_rows, bool))
                else:
                    meta = meta_view(*(c.to_numpy() for c in batch.columns[-2:]))
                    scores = model(text_view(batch.column(at).to_pylist(), hasher), meta)
                    own, kept = [pa.array(s) for s in scores], pa.array(scores[2] >= threshold)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *own, kept], [*batch.schema.names[:-2], "p_text", "p_meta", "score", "kept"])

    return docs.select("*", *meta_places()).mapInArrow(run, extended(docs, p_text=T.DoubleType(), p_meta=T.DoubleType(), score=T.DoubleType(), kept=T.BooleanType()))


def op6_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both views' and the combined score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    views = train(docs, table(spark, sf_dir, "labels"))
    return classify(docs, views).select("doc_id", *[F.round(c, 6).alias(c) for c in ("p_text", "p_meta", "score")], "kept")
