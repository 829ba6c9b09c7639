"""Quality rules: base rules on word statistics, then gradient-boosted trees over document statistics.

The trees are flattened into numpy node arrays, so a batch of documents walks each tree level by level
without a Python loop over rows. Chosen features are monotone: more of them never raises the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm.common import bounded, extended, labelled_sample, light_batches, slices, table, without

WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "stops", "distinct", "marks")
#: Features of which more is never better.
FALLING = ("symbols", "dup_lines", "repeats", "marks")

_SPACE = np.frombuffer(b"\x20\x09\x0a\x0b\x0c\x0d", np.uint8)
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_MARKS = np.array([i for i in range(33, 127) if not chr(i).isalnum()])


def _repeated(words: list[bytes]) -> int:
    """Words in 8-word windows that the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    step = 1
    while step < WINDOW:  # windows of 2, 4 and 8 words, numbered by the two halves they consist of
        ids = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        ids = np.unique(ids, return_inverse=True)[1]
        step *= 2
    twice = np.bincount(ids)[ids] > 1
    if not twice.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += twice
    edges[WINDOW : WINDOW + n] -= twice
    return int((np.cumsum(edges) > 0).sum())


def measures(text: str | None) -> tuple[list[int], list[float]]:
    """COUNTS and FEATURES of one whole text."""
    data = (text or "").encode()
    words = data.split()  # for bytes: \\x20 and \\x09-\\x0D
    n = len(words)
    if not n:
        return [0] * len(COUNTS), [0.0] * len(FEATURES)
    of = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    points = len(data) - int(of[128:192].sum())
    letters = points - int(of[_SPACE].sum())
    symbols = int(of[_SYMBOLS].sum())
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeats = _repeated(words)
    kinds = len(set(words))
    shares = [np.log1p(n), letters / n, symbols / n, dup / max(len(lines), 1), repeats / n, of[65:91].sum() / points, of[48:58].sum() / points, (of[ord(".")] + of[ord(",")]) / n, kinds / n, of[_MARKS].sum() / points]
    return [n, letters, symbols, dup, repeats], [float(x) for x in shares]


def _measured(batches: Iterator[pa.RecordBatch], at: int, score=None, names: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, at)):
        both = [measures(t) for t in batch.column(at).to_pylist()]
        counts = np.array([x[0] for x in both], np.int64).reshape(-1, len(COUNTS))
        features = np.array([x[1] for x in both], np.float64).reshape(-1, len(FEATURES))
        if score is None:
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(f) for f in features.T)], [*batch.schema.names, *names])
            continue
        marks = score(features)
        n, repeats = counts[:, 0], counts[:, 4]
        failed = (n < 20) | (100 * repeats > 30 * n)
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(marks[0]), pa.array(~failed & marks[1])], [*batch.schema.names, *names])


@dataclass
class Forest:
    """Trees side by side: row t of each array holds the nodes of tree t; a leaf is its own child."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    start: float
    threshold: float = 0.5

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, left, right, value in zip(self.feature, self.cut, self.left, self.right, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = np.where(x[rows, feature[node]] <= cut[node], left[node], right[node])
            total += value[node]
        return 1 / (1 + np.exp(-total))

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.probability(x)
        return p, p >= self.threshold


def fit_forest(x: np.ndarray, y: np.ndarray, falling: tuple[int, ...] = (), trees: int = 40, depth: int = 3, bins: int = 32, rate: float = 0.2, ridge: float = 1.0, threshold: float = 0.5) -> Forest:
    """Boost ``trees`` trees on the logistic loss of ``y`` (0 or 1).

    A split on a feature in ``falling`` is taken only if its right leaf is not higher than its left one, and
    every leaf below stays on its side of the middle of the two, so the score falls in that feature everywhere.
    """
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], 1)
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    size = 2 ** (depth + 1)
    arrays = {k: np.zeros((trees, size), d) for k, d in (("feature", int), ("cut", float), ("left", int), ("right", int), ("value", float))}
    score = np.full(len(y), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        used = 1
        work = [(0, np.arange(len(y)), 0, -np.inf, np.inf)]
        while work:
            node, rows, level, low, high = work.pop()
            arrays["left"][t, node] = arrays["right"][t, node] = node
            arrays["value"][t, node] = rate * np.clip(g[rows].sum() / (h[rows].sum() + ridge), low, high)
            score[rows] += arrays["value"][t, node] if level == depth else 0
            best = (1e-6, -1, 0, 0.0) if level < depth else (np.inf,)
            for f in range(x.shape[1] if level < depth else 0):
                if not len(cuts[f]):
                    continue
                gs, hs = (np.cumsum(np.bincount(binned[rows, f], v[rows], len(cuts[f]) + 1)) for v in (g, h))
                gl, hl, gr, hr = gs[:-1], hs[:-1], gs[-1] - gs[:-1], hs[-1] - hs[:-1]
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gs[-1] ** 2 / (hs[-1] + ridge)
                vl, vr = gl / (hl + ridge), gr / (hr + ridge)
                gain[(hl < 1) | (hr < 1) | ((f in falling) & (np.clip(vr, low, high) > np.clip(vl, low, high)))] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k, float(np.clip((vl[k] + vr[k]) / 2, low, high)))
            if level == depth:
                continue
            if best[1] < 0:
                score[rows] += arrays["value"][t, node]
                continue
            _, f, k, middle = best
            arrays["feature"][t, node], arrays["cut"][t, node] = f, cuts[f][k]
            arrays["left"][t, node], arrays["right"][t, node] = used, used + 1
            below = binned[rows, f] <= k
            for child, own, first in ((used, rows[below], True), (used + 1, rows[~below], False)):
                bounds = (low, high) if f not in falling else (middle, high) if first else (low, middle)
                work.append((child, own, level + 1, *bounds))
            used += 2
    return Forest(**arrays, depth=depth, start=start, threshold=threshold)


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", max_rows: int = 8000, text: str = "text", threshold: float = 0.5) -> Forest | None:
    """A forest fitted on at most ``max_rows`` labelled documents; None where no or only one class is labelled.

    Null and empty texts are rows like others. Rows with equal id and text count once, those that repeat an id with
    other texts each; which ones are taken, and so the fit, depends on ids and texts alone.
    """
    light_batches(docs.sparkSession)
    own = labelled_sample(docs.select("doc_id", text), labels, target, max_rows, text)
    names = [f"f_{n}" for n in FEATURES]
    at = own.columns.index(text)
    measured = own.mapInArrow(lambda b: _measured(b, at, None, names), extended(own, **{n: T.DoubleType() for n in names}))
    rows = bounded(measured.select("target_", "row_", *names), max_rows).toPandas()
    y = rows["target_"].to_numpy()
    if len(set(y)) < 2:
        return None
    return fit_forest(rows[names].to_numpy(), y, tuple(FEATURES.index(n) for n in FALLING), threshold=threshold)


def judge(docs: DataFrame, forest: Forest | None, text: str = "text") -> DataFrame:
    """``docs`` with COUNTS, base_failed, quality_score and kept.

    One row per input row; columns of these names are replaced. A null or empty text counts as no words and
    fails the base rules. Without a forest the score is null and the base rules alone decide. Rows are
    independent, so ties, repeated rows and null ids need no rule. Texts are measured whole; a very long one is alone in
    its slice. An empty table stays empty. No shuffle.
    """
    light_batches(docs.sparkSession)
    names = (*COUNTS, "base_failed", "quality_score", "kept")
    docs = without(docs, *names)
    schema = extended(docs, **{n: T.LongType() for n in COUNTS}, base_failed=T.BooleanType(), quality_score=T.DoubleType(), kept=T.BooleanType())
    at = docs.columns.index(text)
    score = forest or (lambda x: ([None] * len(x), np.ones(len(x), bool)))
    return docs.mapInArrow(lambda b: (_typed(r) for r in _measured(b, at, score, names)), schema)


def _typed(batch: pa.RecordBatch) -> pa.RecordBatch:
    k = batch.schema.get_field_index("quality_score")
    return batch.set_column(k, "quality_score", batch.column(k).cast(pa.float64()))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the forest's verdict for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = train(docs, table(spark, sf_dir, "labels"))
    return judge(docs, forest).select("doc_id", *COUNTS, "base_failed", "kept", F.round("quality_score", 6).alias("quality_score"))
