"""SentencePiece encoding and decoding by a table of distinct marked words.

No piece of the model holds a whitespace marker behind another character, so no piece can reach over the
start of a marked word (a run of markers and what follows up to the next run). A task cuts its texts into
marked words, has each distinct one segmented once, and joins the ids back to the texts by position.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm.common import extended, light_batches, table, without

MARK = "▁"
_WORD = re.compile(" +[^ ]*")


def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def check_model(model: bytes) -> None:
    """Raise ValueError unless marked words of this model can be segmented one by one."""
    sp = _processor(model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
        raise ValueError("a piece of this model reaches over the start of a marked word")
    if MARK not in pieces or sp.decode(sp.encode("  a  ﬁ ")) != "  a  ﬁ ":
        raise ValueError("this model changes texts before it encodes them")


class WordTable(dict):
    """The number of each distinct marked word, and its ids by that number; emptied when it holds ``most`` words."""

    def __init__(self, model: bytes, most: int = 100_000):
        self.sp, self.most = _processor(model), most
        self.lone = [self.sp.piece_to_id(MARK)]
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.flat, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1, np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each word has."""
        if len(self) > self.most:
            self.reset()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            own = [x or self.lone for x in self.sp.encode([w[1:] for w in self.new])]  # the library adds the first marker
            flat = np.fromiter(chain.from_iterable(own), np.int32)
            ends = self.ends[-1] + np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
            if ends[-1] > len(self.flat):
                self.flat = np.resize(self.flat, max(2 * len(self.flat), int(ends[-1])))
            self.flat[self.ends[-1] : ends[-1]] = flat
            self.ends, self.new = np.concatenate([self.ends, ends]), []
        starts, sizes = self.ends[at], self.ends[at + 1] - self.ends[at]
        return self.flat[spread(starts, sizes)], sizes


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run, one run after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class PieceBytes:
    """What each id decodes to: its piece with spaces for markers, or its single byte."""

    def __init__(self, sp):
        of = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace(MARK, " ").encode() for i in range(sp.get_piece_size()) for p in [sp.id_to_piece(i)]]
        self.sizes = np.array([len(x) for x in of])
        self.starts, self.flat = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(of), np.uint8)

    def texts(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The decoded text of each document; the marker that encoding put before it goes."""
        sizes = self.sizes[ids]
        data = self.flat[spread(self.starts[ids], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        first = ends[:-1][counts > 0]
        data, ends = np.delete(data, first), ends - np.concatenate([[0], np.cumsum(counts > 0)])
        return pa.StringArray.from_buffers(len(counts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))


def _coded(batches: Iterator[pa.RecordBatch], model: bytes, at: int, names: tuple[str, str], rows: int) -> Iterator[pa.RecordBatch]:
    table = WordTable(model)
    pieces = PieceBytes(table.sp)
    for whole in batches:
        for start in range(0, whole.num_rows, rows):
            batch = whole.slice(start, rows)
            words = [_WORD.findall(" " + t.replace(MARK, " ")) if t else [] for t in batch.column(at).to_pylist()]
            ids, sizes = table.ids_of(list(chain.from_iterable(words)))
            words_by = np.concatenate([[0], np.cumsum([len(x) for x in words])])
            ends = np.concatenate([[0], np.cumsum(sizes)])[words_by]
            listed = pa.ListArray.from_arrays(ends.astype(np.int32), ids)
            yield pa.RecordBatch.from_arrays([*batch.columns, listed, pieces.texts(ids, np.diff(ends))], [*batch.schema.names, *names])


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", rows_at_once: int = 100) -> DataFrame:
    """``docs`` with the ids of each whole text and the text that the ids decode to.

    One row per input row, all input columns kept (columns already named like ``ids`` or ``decoded`` are
    replaced). A null or empty text has no ids and decodes to the empty text. Rows are independent, so ties,
    repeated rows and null ids need no rule. No shuffle; a task holds ``rows_at_once`` texts and a bounded
    word table, and loads the model from bytes that travel with the task. Texts are encoded whole, however long. An empty
    table stays empty.
    """
    light_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()
    check_model(model)
    docs = without(docs, ids, decoded)
    schema = extended(docs, **{ids: T.ArrayType(T.IntegerType()), decoded: T.StringType()})
    at = docs.columns.index(text)
    return docs.mapInArrow(lambda batches: _coded(batches, model, at, (ids, decoded), rows_at_once), schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and decoded text of every document."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
