"""Benchmark decontamination by spaced seeds.

A mask keeps some positions of a window of words and ignores the others, so a window still matches after words
at the ignored places were exchanged. Hashes of masked benchmark windows meet those of the documents in an
equi-join; around each hit the words of both sides are laid over one another and the overlap is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import cut, light_batches, slices, table
from ravelin.llm.sketch_join import BITMAP_BITS, bitmap_of
from ravelin.llm.wordhash import WordHasher, mix

#: The positions that each mask keeps. Of 10 to 21 words of which 8 and 70 per cent are equal, wherever those are, all
#: places of a mask are equal somewhere (a test tries every pattern); what is longer has 11 to 21 such words in a row.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 5, 6), (0, 1, 3, 7, 8), (0, 1, 2, 5, 6), (0, 2, 6, 8, 9), (0, 1, 2, 5, 7), (0, 1, 2, 3, 5))


def seeds(words: np.ndarray, counts: np.ndarray, mask: tuple[int, ...], which: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash at each place where the whole mask lies within one text, and those places."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.full(n, which + 1, np.uint64)
    for k in mask:
        total = total * np.uint64(0x9FB21C651E98DF25) + words[k : k + n]
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(words))  # words up to the end of the text
    at = np.flatnonzero(left[:n] > mask[-1])
    return mix(total[at]), at


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (item_id, text) to (item_id, words, seeds, places)."""
    hasher = WordHasher()
    for batch in batches:
        words, counts = hasher.words(batch.column(1).to_pylist())
        both = [seeds(words, counts, m, k) for k, m in enumerate(MASKS)]
        hashes, at = np.concatenate([h for h, _ in both]), np.concatenate([a for _, a in both])
        ends = np.cumsum(counts)
        of = np.searchsorted(ends, at, side="right")
        by = np.argsort(of, kind="stable")
        at = at - (ends - counts)[of] if len(at) else at
        cuts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(counts)))]).astype(np.int32)
        lists = lambda x, c: pa.ListArray.from_arrays(pa.array(c, pa.int32()), pa.array(x))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists(words.view(np.int64), np.concatenate([[0], ends]).astype(np.int32)), lists(hashes[by].view(np.int64), cuts), lists(at[by].astype(np.int32), cuts)], ["item_id", "words", "seeds", "places"])


def _runs(batches: Iterator[pa.RecordBatch], held, reach: int) -> Iterator[pa.RecordBatch]:
    """From (doc_id, text) to the runs of hits: doc_id, start, lead, core, words, seeds, places.

    Hits at most ``reach`` words apart form one run. ``words`` go from ``start`` with ``reach`` words around the hits;
    the hits lie in the core, ``lead`` words in; ``places`` count from the core. Equal cores have equal names.
    """
    hasher, bitmap = WordHasher(), held.value
    low = np.uint64((1 << BITMAP_BITS) - 1)

    def there(x: np.ndarray) -> np.ndarray:
        bit = x & low
        return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1

    for whole in batches:
        for batch in slices(whole, 1):
            words, counts = hasher.words(batch.column(1).to_pylist())
            found = []
            for k, mask in enumerate(MASKS):
                h, at = seeds(words, counts, mask, k)
                hit = np.flatnonzero(there(h))
                hit = hit[there(h[hit] >> np.uint64(32))]
                found.append((h[hit], at[hit], np.full(len(hit), mask[-1] + 1)))
            h, at, span = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(h):
                continue
            by = np.argsort(at, kind="stable")
            h, at, span = h[by], at[by], span[by]
            ends = np.cumsum(counts)
            of = np.searchsorted(ends, at, side="right")
            head = np.flatnonzero(np.concatenate([[True], (np.diff(at) > reach) | (np.diff(of) != 0)]))
            tail = np.append(head[1:], len(at))
            rows = []
            for a, b in zip(head, tail, strict=True):
                text = of[a]
                first, last = at[a], int((at[a:b] + span[a:b]).max())
                begin = int((ends - counts)[text])
                start, stop = max(begin, first - reach), min(int(ends[text]), last + reach)
                weights = np.arange(1, last - first + 1, dtype=np.uint64)
                core = int(mix(np.array([np.bitwise_xor.reduce(mix(words[first:last] + mix(weights)))])).view(np.int64)[0])
                rows.append((batch.column(0)[int(text)].as_py(), int(start - begin), int(first - start), core, words[start:stop].view(np.int64), h[a:b].view(np.int64), (at[a:b] - first).astype(np.int32)))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "lead", "core", "words", "seeds", "places"])


def longest_stretch(same: np.ndarray, least: int, equal: int, percent: int) -> tuple[int, int] | None:
    """Start and end of the longest stretch of ``same`` (booleans) within the thresholds, between two true ones.

    Where only false ones beside it make up ``least``, as many of them are taken in. None if there is no stretch.
    """
    if len(same) < least or np.count_nonzero(same) < equal:
        return None
    at = np.flatnonzero(same)
    sums = np.concatenate([[0], np.cumsum(np.where(same, 100 - percent, -percent))])
    starts, ends = sums[at], sums[at + 1]
    best = np.maximum.accumulate(ends[::-1])[::-1]  # from this true one on
    last = np.searchsorted(-best, -starts, side="right") - 1
    length = np.where(last >= np.arange(len(at)), at[np.maximum(last, 0)] + 1 - at, 0)
    k = int(length.argmax())
    if length[k] >= max(least, -(-100 * equal // max(percent, 1))):  # so long that the equal ones are enough
        return int(at[k]), int(at[k] + length[k])
    n = np.arange(len(at))
    for size in range(min(len(same), max(least, -(-100 * equal // max(percent, 1)))), 0, -1):
        to = np.searchsorted(at, at + size - 1)
        held = np.where((to < len(at)) & (at[np.minimum(to, len(at) - 1)] == at + size - 1), to - n + 1, 0)
        k = int(held.argmax())
        if held[k] >= max(equal, 1) and 100 * held[k] >= percent * max(size, least):
            x = int(at[k])
            x = max(0, min(x - (max(size, least) - size) // 2, len(same) - max(size, least)))
            return x, x + max(size, least)
    return None


def stretches(same: np.ndarray, least: int, equal: int, percent: int) -> list[tuple[int, int]]:
    """The longest stretch within the thresholds, then those on either side of it, and so on."""
    out, left = [], [(0, len(same))]
    while left:
        lo, hi = left.pop()
        found = longest_stretch(same[lo:hi], least, equal, percent)
        if found:
            x, y = lo + found[0], lo + found[1]
            out.append((x, y))
            left += [(lo, x), (y, hi)]
    return out


def _overlaps(batches: Iterator[pa.RecordBatch], least: int, equal: int, percent: int) -> Iterator[pa.RecordBatch]:
    """From (doc_id, start, item, shift, words, item words) to verified overlaps; ``shift``: item place less place in the run."""
    for batch in batches:
        ids, starts, items, shifts, runs, texts = (c.to_pylist() for c in batch.columns)
        out = []
        for doc, start, item, shift, run, text in zip(ids, starts, items, shifts, runs, texts, strict=True):
            a, b = np.array(run, np.int64), np.array(text, np.int64)
            lo, hi = max(0, -shift), min(len(a), len(b) - shift)
            if hi <= lo:
                continue
            same = a[lo:hi] == b[lo + shift : hi + shift]
            out += [(doc, item, start + lo + x, y - x, int(same[x:y].sum())) for x, y in stretches(same, least, equal, percent)]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["doc_id", "item", "start", "n_words", "n_equal"])


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", least: int = 10, equal: int = 8, percent: int = 70) -> DataFrame:
    """doc_id, item_id, start (in words), n_words and n_equal of each verified overlap of a document with an item.

    Words are compared with A-Z lower-cased. Overlaps are stretches on one diagonal around a hit, the longest first
    and then those beside it: at least ``least`` words, ``equal`` of them and ``percent`` per cent equal at their
    place. With the defaults or stricter thresholds no text that has such a stretch is missed; with lower ones only
    what holds a mask is found. Diagonals are compared over the whole item: a run has as many words around its
    hits as the longest item. No rows for null, empty or short texts on either side; an item with fewer words than a
    mask has no seed of that mask. Null ids are reported as such, repeated rows once; other columns are not read. Texts
    are searched whole; of a very long one only the runs around its hits travel. An empty table gives no rows.

    The documents are read once. A bitmap of fixed size, made from all benchmark seeds, drops windows that match
    none; what passes meets the seeds in a join, equal cores once and items with equal words once. Nothing here
    grows with either side on the driver or in a broadcast.
    """
    light_batches(docs.sparkSession)
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text).distinct()
    items = benchmark.mapInArrow(_items, "item_id long, words array<long>, seeds array<long>, places array<int>")
    items = cut(items.withColumn("item", F.xxhash64("words")))  # a key of its own: ids may be null or name equal words
    reach = items.agg(F.max(F.size("words"))).first()[0] or 0
    told = items.dropDuplicates(["item"])
    index = told.select("item", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select(F.col("s.seeds").alias("seed"), "item", F.col("s.places").alias("place"))
    probes = index.select(F.explode(F.array("seed", F.shiftrightunsigned("seed", 32))).alias("probe"))
    held = docs.sparkSession.sparkContext.broadcast(bitmap_of(probes, "probe", BITMAP_BITS))
    runs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(lambda b: _runs(b, held, reach), "doc_id long, start long, lead int, core long, words array<long>, seeds array<long>, places array<int>")
    runs = cut(runs)
    cores = runs.groupBy("core").agg(F.first(F.arrays_zip("seeds", "places")).alias("hits"))
    hits = cores.select("core", F.explode("hits").alias("h")).select("core", F.col("h.seeds").alias("seed"), F.col("h.places").alias("at"))
    pairs = hits.join(index, "seed").select("core", "item", (F.col("place") - F.col("at")).alias("shift")).distinct()
    laid = runs.select("doc_id", "start", "lead", "core", "words").join(pairs, "core").select("doc_id", "start", "item", (F.col("shift") - F.col("lead")).alias("shift"), "words")
    laid = laid.join(told.select("item", F.col("words").alias("item_words")), "item").select("doc_id", "start", "item", "shift", "words", "item_words")
    found = laid.mapInArrow(lambda b: _overlaps(b, least, equal, percent), "doc_id long, item long, start long, n_words long, n_equal long").distinct()
    return found.join(items.select("item", "item_id").distinct(), "item").select("doc_id", "item_id", "start", "n_words", "n_equal")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest verified overlap of each document and benchmark item that have one."""
    found = find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_words", "n_equal", F.negative("start").alias("s"))).alias("m")).select("doc_id", "item_id", F.negative("m.s").alias("start"), "m.n_words", "m.n_equal")
