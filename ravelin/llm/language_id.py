"""Language identification, words first.

A known word counts with its log frequency in each language. An unseen word falls back to its longest character
n-grams that are known, from ``longest`` characters down to one. A word is a letter and the letters and combining
marks after it, as Unicode has them; digits, numeric symbols and all else part words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ravelin.llm.common import extended, light_batches, slices, table, without

UNKNOWN = "und"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def _counted(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    """From (text, language) to (language, size, gram, n): size 0 for words, else n-grams of that size; summed within a task."""
    words: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for language, own in words.items():
            grams: Counter = Counter()
            for word, n in own.items():
                grams[0, word] += n
                padded = f"^{word}$"
                for size in range(1, longest + 1):
                    for i in range(len(padded) - size + 1):
                        grams[size, padded[i : i + size]] += n
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(grams)), pa.array([k[0] for k in grams], pa.int32()), pa.array([k[1] for k in grams]), pa.array(list(grams.values()), pa.int64())], ["language", "size", "gram", "n"])
        words.clear()

    for batch in batches:
        for text, language in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.setdefault(language, Counter()).update(_WORD.findall((text or "").lower()))
        if sum(map(len, words.values())) > 200_000:
            yield from flush()
    yield from flush()


@dataclass
class Model:
    """Log frequencies: one row per known gram, one column per language, and a last row of zeros."""

    languages: list[str]
    grams: list[dict[str, int]]  # by size, words first: the row of each
    logs: np.ndarray

    def rows_of(self, word: str) -> list[int]:
        """The row of a known word, else those of its longest known n-grams, else the row of zeros."""
        if (row := self.grams[0].get(word)) is not None:
            return [row]
        padded = f"^{word}$"
        for size in range(min(len(self.grams) - 1, len(padded)), 0, -1):
            known = self.grams[size].get
            if rows := [r for i in range(len(padded) - size + 1) if (r := known(padded[i : i + size])) is not None]:
                return rows
        return [len(self.logs) - 1]


class Scorer(dict):
    """Numbers words as they come and keeps what each says; forgets all when it holds ``most`` words."""

    def __init__(self, model: Model, most: int = 300_000):
        self.model, self.most = model, most
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.says = np.zeros((0, len(self.model.languages)))

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def scores(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if len(self) > self.most:
            self.reset()
        words = [_WORD.findall(t.lower()) if t else [] for t in texts]
        n = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
        if self.new:
            rows = [self.model.rows_of(w) for w in self.new]
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            flat = np.fromiter(chain.from_iterable(rows), np.int64, int(sizes.sum()))
            mean = np.add.reduceat(self.model.logs[flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
            self.says, self.new = np.concatenate([self.says, mean]), []
        of = np.repeat(np.arange(len(texts)), n)
        total = np.stack([np.bincount(of, self.says[at, k], len(texts)) for k in range(len(self.model.languages))], 1)
        odds = np.exp(total - total.max(1, keepdims=True))
        best = total.argmax(1)
        share = np.where(n > 0, odds[np.arange(len(texts)), best] / odds.sum(1), 0.0)
        return [self.model.languages[k] if m else UNKNOWN for k, m in zip(best, n, strict=True)], share


def train(docs: DataFrame, label: str = "lang", text: str = "text", longest: int = 4, max_rows: int = 4000) -> Model | None:
    """Learn from at most ``max_rows`` labelled rows, as many of each language, chosen by a hash of doc_id and text.

    A language has at most 1,000 of them; with more than ``max_rows`` languages some have none. Rows that repeat id,
    text and label count once; null labels and texts are left out. All words and n-grams of the chosen rows are kept.
    None where nothing is labelled.
    """
    light_batches(docs.sparkSession)
    own = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.xxhash64("doc_id", text).alias("h"), text, F.col(label).cast("string").alias("language"))
    rows = own.select("h", "language").distinct()
    n = rows.select("language").distinct().count()
    if not n:
        return None
    first = W.partitionBy("language").orderBy("h")
    chosen = rows.withColumn("k", F.row_number().over(first)).where(F.col("k") <= max(1, min(1000, max_rows // n))).orderBy("k", "h").limit(max_rows).select("h", "language")
    own = own.join(F.broadcast(chosen), ["h", "language"]).dropDuplicates(["h", "language"]).select(text, "language")
    grams = own.mapInArrow(lambda b: _counted(b, longest), "language string, size int, gram string, n long").groupBy("size", "gram", "language").agg(F.sum("n").alias("n"))
    found = grams.toArrow()
    languages = sorted(set(found["language"].to_pylist()))
    known: list[dict[str, int]] = [{} for _ in range(longest + 1)]
    sizes, names, of = (found[c].to_pylist() for c in ("size", "gram", "language"))
    place = {x: k for k, x in enumerate(languages)}
    at = [known[size].setdefault(gram, len(known[size])) for size, gram in zip(sizes, names, strict=True)]
    begin = np.concatenate([[0], np.cumsum([len(x) for x in known])])
    counts = np.full((int(begin[-1]), len(languages)), 0.5)
    counts[np.array(at, np.int64) + begin[np.array(sizes, np.int64)], [place[x] for x in of]] += found["n"].to_numpy()
    logs = np.concatenate([np.log(counts[lo:hi] / counts[lo:hi].sum(0)) for lo, hi in zip(begin[:-1], begin[1:], strict=True)])
    logs -= logs.mean(1, keepdims=True)  # what a gram says for one language over the others
    known = [{gram: k + int(lo) for gram, k in x.items()} for x, lo in zip(known, begin, strict=False)]
    return Model(languages, known, np.concatenate([logs, np.zeros((1, len(languages)))]))


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (the share of the best language, 0 to 1).

    Null and empty texts, texts without a letter, and all texts without a model: und, 0. Of equal languages the
    first by name wins. Only the text is read, whole, a very long one alone in its slice; one row per input row, so ties,
    repeated rows and null ids need no rule; columns of these names are replaced. An empty table stays empty.
    """
    light_batches(docs.sparkSession)
    docs = without(docs, "lang_pred", "score")
    at = docs.columns.index(text)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(held.value) if held.value else None
        for whole in batches:
            for batch in slices(whole, at):
                names, best = own.scores(batch.column(at).to_pylist()) if own is not None else ([UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(best, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, extended(docs, lang_pred=T.StringType(), score=T.DoubleType()))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = train(docs.where("NOT held_out"))
    return identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", F.round("score", 6).alias("score"))
