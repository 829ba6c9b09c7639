"""Filter interaction audit: what each filter of a chain does in every order of the chain.

Rows fold to counts by part and mask of failed filters. A subset-zeta transform turns a part's counts into the
survivors of every subset of filters; what a step of an order removes is the difference of two neighbouring subsets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ravelin.llm.common import light_batches, slices, table

_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_SIGNS = np.zeros(256, np.int64)
_SIGNS[list(b"#$%&*|")] = 1
COUNTED = ("n", "good", "toxic")


def failures(text: str | None) -> tuple[int, bytes]:
    """The mask of failed conditions of a whole text (1: A, 2: B, 4: C, 8: D), and a 128-bit digest; null is empty."""
    data = (text or "").encode()
    words = data.split()  # for bytes: \\x20 and \\x09-\\x0D
    of = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    points = len(data) - int(of[128:192].sum())
    short, dull = len(words) < 200, 100 * len(set(words)) < 50 * len(words)
    loud, signs = 100 * int(of @ _UPPER) > 2 * points, int(of @ _SIGNS) > 0
    return short + 2 * dull + 4 * loud + 8 * signs, hashlib.blake2b(data, digest_size=16).digest()


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, part, text) to (doc_id, part, mask, digest)."""
    for whole in batches:
        for batch in slices(whole, 2):
            both = [failures(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m for m, _ in both], pa.int32()), pa.array([d for _, d in both], pa.binary())], ["doc_id", "part", "mask", "digest"])


def text_counts(docs: DataFrame, labels: DataFrame, copy: int = 16) -> DataFrame:
    """``docs`` (doc_id, text, source) to (part, mask, n, good, toxic): n rows of a part fail just the filters in ``mask``.

    The four conditions of ``failures``, and ``copy`` where a smaller doc_id has the same text anywhere in the table,
    kept or not. Rows with one doc_id do not make each other copies; null ids are no copies, make none, and have no
    label. good and toxic are the rows for which ``labels`` says quality or toxic 1; an id with several labels counts
    once, as 1 where any says so. A null text is the empty one and a null source the empty part. Texts are read whole
    and do not travel: equality is that of 128-bit digests. Other columns are ignored; an empty table gives no rows.

    A group of copies folds to one row a part and label before its ids are compared, however large it is.
    """
    light_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    rows = own.mapInArrow(_masked, "doc_id long, part string, mask int, digest binary").groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    held = rows.join(told, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in COUNTED[1:]})
    folded = held.groupBy("digest", "part", "mask", *COUNTED[1:]).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first")
    )
    here = F.col("first") == F.min("first").over(W.partitionBy("digest"))  # a row a part and label: no group of copies is large here
    folded = folded.withColumn("copies", F.col("n") - F.col("nameless") - F.when(here, F.col("n_first")).otherwise(0))
    both = F.explode(F.array(F.struct("mask", (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + copy).alias("mask"), F.col("copies").alias("n")))).alias("r")
    counted = folded.select("part", both, *COUNTED[1:]).where("r.n > 0")
    return counted.groupBy("part", F.col("r.mask").alias("mask")).agg(F.sum("r.n").alias("n"), *[F.sum(F.when(F.col(c), F.col("r.n")).otherwise(0)).alias(c) for c in COUNTED[1:]])


def survivors(counts: np.ndarray) -> np.ndarray:
    """Subset-zeta transform over the last axis: from counts by mask to rows that fail no filter of each subset."""
    size = counts.shape[-1]
    k = size.bit_length() - 1
    z = counts.reshape(-1, *[2] * k)  # axis 1 is the highest bit
    for axis in range(1, k + 1):
        none = np.take(z, [0], axis)
        z = np.concatenate([none + np.take(z, [1], axis), none], axis)
    return z.reshape(counts.shape)


def order_steps(filters: str) -> dict[str, np.ndarray]:
    """Every step of every order of ``filters``: the order, the step, and the subsets before and after it."""
    orders = list(permutations(range(len(filters))))
    bits = 1 << np.array(orders)
    after = np.cumsum(bits, 1)
    return {
        "filter_order": np.repeat(["".join(filters[f] for f in o) for o in orders], len(filters)),
        "step": np.tile(np.arange(1, len(filters) + 1), len(orders)),
        "bit": bits.ravel(),
        "before": (after - bits).ravel(),
        "after": after.ravel(),
    }


def _shapley(z: np.ndarray, k: int) -> np.ndarray:
    """What each filter removes, summed over all orders: a difference of neighbours counts once for each order through it."""
    out = np.zeros((len(z), k), np.int64)
    for f in range(k):
        for s in range(1 << k):
            if not s >> f & 1:
                size = bin(s).count("1")
                out[:, f] += factorial(size) * factorial(k - 1 - size) * (z[:, s] - z[:, s | 1 << f])
    return out


def _stepped(batches: Iterator[pa.RecordBatch], filters: str) -> Iterator[pa.RecordBatch]:
    """From (part, array of counts for each of COUNTED) to the rows of ``audit``, 64 parts at a time."""
    k, steps = len(filters), order_steps(filters)
    before, after, bit, whole = steps["before"], steps["after"], steps["bit"], (1 << k) - 1
    letter = np.log2(bit).astype(int)
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            some = batch.slice(at, 64)
            counts = {c: np.stack(some.column(c).to_numpy(zero_copy_only=False)).astype(np.int64) for c in COUNTED}
            z = {c: survivors(v) for c, v in counts.items()}
            removed = z["n"][:, before] - z["n"][:, after]
            long = {
                "kept": z["n"][:, after],
                "removed": removed,
                "redundant": z["n"][:, [0]] - z["n"][:, bit] - removed,
                "unique_fails": z["n"][:, whole - bit] - z["n"][:, [whole]],
                "good_lost": z["good"][:, before] - z["good"][:, after],
                "toxic_lost": z["toxic"][:, before] - z["toxic"][:, after],
                "shapley": _shapley(z["n"], k)[:, letter],
            }
            parts = pa.array(np.repeat(np.arange(some.num_rows), len(bit)))
            fixed = [some.column("part").take(parts), pa.array(np.tile(steps["filter_order"], some.num_rows)), pa.array(np.tile(steps["step"], some.num_rows).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*fixed, *(pa.array(v.ravel()) for v in long.values())], ["part", "filter_order", "step", *long])


def audit(counts: DataFrame, filters: str) -> DataFrame:
    """Every step of every order of ``filters`` in every part of ``counts`` (part, mask, n, good, toxic).

    Bit i of a mask stands for failing ``filters[i]``; at most eight filters. Rows with equal part and mask add up and
    null counts are zeros. Per part, order and step: the rows kept after it, removed in it, redundant (failing its
    filter but removed before), unique_fails (failing its filter alone), good_lost and toxic_lost (the good and toxic
    among the removed), shapley (removed by its filter, summed over all orders). Steps without rows are there with
    zeros; without rows there are no parts, so no result. A part is one row of 2**k numbers before it is unfolded.
    """
    if not 0 < len(filters) <= 8:
        raise ValueError("one to eight filters")
    size = 1 << len(filters)
    held = counts.groupBy("part", "mask").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTED])
    spread = lambda c: F.expr(f"transform(sequence(0, {size - 1}), m -> coalesce(map_from_entries(held_)[m].{c}, 0L))").alias(c)
    vectors = held.groupBy("part").agg(F.collect_list(F.struct(F.col("mask").cast("int"), F.struct(*COUNTED))).alias("held_")).select("part", *[spread(c) for c in COUNTED])
    long = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return vectors.mapInArrow(lambda b: _stepped(b, filters), f"part string, filter_order string, step int, {long}")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five text filters in all 120 orders, for each source."""
    return audit(text_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "ABCDE")


OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS first_id FROM words GROUP BY text
), told AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    len(w) < 200 AS a,
    100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(words.doc_id > first_id, false) AS e
  FROM words JOIN firsts USING (text) LEFT JOIN told USING (doc_id)
), masks AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails,
    count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM failed GROUP BY part, fails
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE b.f <> a.f AND c.f NOT IN (a.f, b.f) AND d.f NOT IN (a.f, b.f, c.f) AND e.f NOT IN (a.f, b.f, c.f, d.f)
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS earlier FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s
), judged AS (
  SELECT m.part, s.filter_order, s.step, s.f, m.n, m.good, m.toxic,
    contains(m.fails, s.f) AS fails_it,
    s.earlier <> '' AND translate(m.fails, s.earlier, '') <> m.fails AS gone,
    m.fails = s.f AS alone
  FROM masks m, steps s
), summed AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN NOT gone AND NOT fails_it THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN NOT gone AND fails_it THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND fails_it THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND fails_it THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN NOT gone AND fails_it THEN toxic ELSE 0 END) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM summed
"""
