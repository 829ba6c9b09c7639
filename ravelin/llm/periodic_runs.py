"""Periodic runs of words, found on harmonic grids.

A run of period p that spans two periods holds two neighbouring points jp and (j+1)p of the grid of step p. How far
the words agree before and after such a pair gives the run's ends. Both extensions are longest common extensions: range
minima over the common prefixes of neighbours in a suffix array, and in the suffix array of the reversed words. The
grids of a text of n words have about n ln n pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm.common import extended, light_batches, slices, table, without

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)


class Extensions:
    """Longest common extensions of suffixes of ``ids``, whose values that end a text occur once each."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        order = np.argsort(ids, kind="stable")
        levels, rank, at = [], np.empty(n, np.int64), np.arange(n)
        own, keys, h = order, ids[order], 0
        while True:  # suffixes in one group agree in their first max(1, 2h) words; a group's rank is the place of its first
            head = np.ones(len(at), bool)
            head[1:] = keys[1:] != keys[:-1]
            group = np.cumsum(head) - 1
            rank[own] = at[head][group]
            levels.append(rank.astype(np.int32))
            shared = np.bincount(group, minlength=1)[group] > 1 if len(group) else head
            if not shared.any():
                break
            at, own, h = at[shared], own[shared], max(1, 2 * h)
            keys = rank[own] * n + rank[own + h]
            turn = np.argsort(keys, kind="stable")
            own, keys = own[turn], keys[turn]
            order[at] = own
        self.rank = levels[-1]
        a, b = order[:-1], order[1:]
        common = np.zeros(max(n - 1, 0), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            common += (levels[k][a + common] == levels[k][b + common]).astype(np.int64) << k
        self.least = [common.astype(np.int32)]  # least[k][i]: of the 2**k neighbours from i on
        while 2 << (len(self.least) - 1) <= len(common):
            k, last = len(self.least) - 1, self.least[-1]
            self.least.append(np.minimum(last[: -(1 << k)], last[1 << k :]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words the suffixes at ``i`` and ``j``, different places, have in common."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self.least[k][lo[own]], self.least[k][hi[own] - (1 << k)])
        return out


def grid(sizes: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, p, jp) for all neighbouring points of all grids of texts of so many words, about ``most`` at a time."""
    of = np.repeat(np.arange(len(sizes)), sizes // 2)
    first = np.cumsum(sizes // 2) - sizes // 2
    p = np.arange(len(of)) - first[of] + 1
    n = (sizes[of] - 1) // p
    ends = np.cumsum(n)
    lo = 0
    while lo < len(p):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - n[lo] + most, side="right")))
        own = np.repeat(np.arange(lo, hi), n[lo:hi])
        j = np.arange(len(own)) - (ends[own] - n[own] - (ends[lo] - n[lo]))
        yield of[own], p[own], j * p[own]
        lo = hi


def find_runs(texts: list[list], least: int = 12) -> tuple[np.ndarray, ...]:
    """All maximal runs of several texts, lists of words: (text, start, length, smallest period), in this order."""
    sizes = np.array([len(w) for w in texts], np.int64)
    ids, base = [np.zeros(1, np.int64)], 1
    for w in texts:  # numbers of a text are its own, and each text is followed by one that occurs once
        known: dict = {}
        ids.append(np.fromiter((known.setdefault(x, len(known)) for x in w), np.int64, len(w)) + base)
        ids.append(np.array([base + len(known)], np.int64))
        base += len(known) + 1
    ids = np.concatenate(ids)
    starts = np.cumsum(sizes + 1) - sizes  # of the texts within ids
    ahead = back = None
    found = []
    for of, p, at in grid(sizes):
        i = starts[of] + at
        same = ids[i] == ids[i + p]  # others extend by nothing forwards
        of, p, i = of[same], p[same], i[same]
        if not len(of):
            continue
        if ahead is None:
            ahead, back = Extensions(ids), Extensions(ids[::-1])
        left = i - back(len(ids) - i, len(ids) - i - p)
        length = i + p + ahead(i, i + p) - left
        runs = length >= np.maximum(least, 2 * p)
        found.append(np.stack([of[runs], left[runs] - starts[of[runs]], length[runs], p[runs]]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    # a run shows on the grids of the multiples of its period too, and at many points: the smallest period stays
    of, start, length, period = np.unique(np.concatenate(found, 1), axis=1)
    first = np.ones(len(of), bool)
    first[1:] = (of[1:] != of[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    of, start, length, period = of[first], start[first], length[first], period[first]
    turn = np.lexsort((period, start, of))
    return of[turn], start[turn], length[turn], period[turn]


def _collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> str:
    if not len(start):
        return b" ".join(words).decode()
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]).decode()


def _searched(batches: Iterator[pa.RecordBatch], at: int, least: int) -> Iterator[pa.RecordBatch]:
    kinds = pa.struct([pa.field(f.name, pa.int64(), False) for f in RUNS.elementType.fields])
    for whole in batches:
        for batch in slices(whole, at):
            texts = [(t or "").encode().split() for t in batch.column(at).to_pylist()]  # bytes: \\x20 and \\x09-\\x0D
            of, *run = find_runs(texts, least)
            edges = np.searchsorted(of, np.arange(len(texts) + 1))
            kept = [_collapsed(w, *(x[lo:hi] for x in run)) for w, lo, hi in zip(texts, edges[:-1], edges[1:], strict=True)]
            runs = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in run], fields=list(kinds)), type=pa.list_(pa.field("element", kinds, False)))
            yield pa.RecordBatch.from_arrays([*batch.columns, runs, pa.array(kept, pa.string())], [*batch.schema.names, "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text: str = "text", least: int = 12) -> DataFrame:
    """``docs`` with runs (start, length, period; by start, then period) and collapsed, the text without repeats.

    Words are runs of characters other than \\x20 and \\x09-\\x0D, as they are. A run is a stretch with smallest period
    q, at least ``least`` and 2 q words long, that no word beside it extends with period q. The collapsed text has the
    words that stand in no run after its first q words, with single blanks between. Null and empty texts have no runs
    and collapse to the empty text. Texts are searched whole; a very long one is alone in its batch and takes some 300
    bytes a word. Rows are independent, so ties, repeated rows and null ids need no rule; columns of these names are
    replaced; an empty table stays empty. No shuffle.
    """
    light_batches(docs.sparkSession)
    docs = without(docs, "runs", "collapsed")
    at = docs.columns.index(text)
    return docs.mapInArrow(lambda b: _searched(b, at, least), extended(docs, runs=RUNS, collapsed=T.StringType()))


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text), where a tenth of the ids get a periodic tail that the id determines; a null id gets none."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, words = F.floor(h / 10), F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    tail = "transform(sequence(a_, n_ - 1), i -> words_[a_ + (i - a_) % p_])"
    planted = (
        docs.withColumn("g_", g)
        .withColumn("words_", F.when(h % 10 == 0, words))
        .withColumn("n_", F.size("words_"))
        .withColumn("a_", F.expr("cast(CASE WHEN n_ > 0 THEN g_ % n_ END AS int)"))
        .withColumn("p_", F.expr("cast(1 + floor((n_ - a_) / (3 + g_ % 8)) AS int)"))
    )
    return planted.withColumn("text", F.expr(f"CASE WHEN n_ > 0 THEN array_join(concat(slice(words_, 1, a_), {tail}), ' ') ELSE text END")).drop("g_", "words_", "n_", "a_", "p_")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs, the longest of them, and digests of all and of the collapsed text."""
    found = periodic_runs(with_planted_tails(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.expr("array_min(transform(runs, r -> struct(-r.length AS length, r.start AS start, r.period AS period)))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    own = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("r.length")
    return own.select("doc_id", "n_runs", F.col("r.start").alias("start"), length.alias("length"), F.col("r.period").alias("period"), F.floor(1000 * length / F.col("r.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


OP12_SQL = r"""
WITH RECURSIVE crc(doc_id, digits, k, c) AS (
  SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, digits, k + 1, CASE WHEN b % 2 = 1 THEN xor(b // 2, CAST(3988292384 AS BIGINT)) ELSE b // 2 END
  FROM (SELECT doc_id, digits, k, CASE WHEN k % 8 = 0 THEN xor(c, CAST(ascii(substr(digits, k // 8 + 1, 1)) AS BIGINT)) ELSE c END AS b FROM crc WHERE k < 8 * length(digits)) x
), hashed AS (
  SELECT doc_id, xor(c, CAST(4294967295 AS BIGINT)) AS h FROM crc WHERE k = 8 * length(digits)
), rows_ AS (
  SELECT row_number() OVER () AS r, d.doc_id, coalesce(h, 1) AS h, coalesce(h, 1) // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents d LEFT JOIN hashed USING (doc_id)
), tails AS (
  SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) ELSE len(w) END AS a FROM rows_
), planted AS (
  SELECT *, CASE WHEN a < n THEN 1 + (n - a) // (3 + g % 8) ELSE 1 END AS p FROM tails
), spots AS (
  SELECT r, n, a, p, w, unnest(range(0, n)) AS i FROM planted WHERE n > 0
), words AS (
  SELECT r, n, i, w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1] AS word FROM spots
), pairs AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i WHERE y.i - x.i <= x.n // 2
), islands AS (
  SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs
), stretches AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY r, q, island HAVING count(*) >= q AND count(*) + q >= 12
), runs AS (
  SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length
), best AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY length DESC, start, period) AS place FROM runs
), listed AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY r
), dropped AS (
  SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN dropped USING (r, i) GROUP BY r
)
SELECT planted.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
  CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM planted LEFT JOIN listed USING (r) LEFT JOIN (SELECT * FROM best WHERE place = 1) b USING (r) LEFT JOIN kept USING (r)
"""
