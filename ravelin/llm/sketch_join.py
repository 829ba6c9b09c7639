"""N-gram Jaccard join by parity sketches.

Each shingle of a document flips one bit of a sketch, so the Hamming distance of two sketches is at most the
symmetric difference of their sets. Two sets that link differ in at most d shingles, d given by the size of the
smaller one. Per size band the sketch is cut into more than d parts: some part of two linked sets agrees. An
equi-join on parts finds the candidates, and their sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.llm.common import cut, light_batches, slices, table
from ravelin.llm.components import components
from ravelin.llm.wordhash import WordHasher, mix, windows

BAND_RATIO = 1.4
#: Bits of a part's sketch; it is kept as the XOR of a random number for each bit set.
PART_BITS = 20
#: Linked sets share at least so many of the parts that both emit.
SHARED = 2
#: Buckets up to this size give their pairs to a join that counts shared buckets; in larger ones sketches are compared.
#: Either way finds all links (a test takes both ways), so this is a matter of cost alone.
SMALL = 8
#: In large buckets so many nodes meet so many others in one cell.
BLOCK = 512
BITMAP_BITS = 26
_ID = "coalesce(doc_id, 9223372036854775807L)"


class Bands:
    """Size bands [low, low of the next) and the parts of each, for links at ``percent`` per cent or more."""

    def __init__(self, percent: int, most: int = 1 << 40):
        lows, low = [1], 1
        while low < most:
            low = max(low + 1, int(low * BAND_RATIO))
            lows.append(low)
        self.lows, self.percent = np.array(lows), percent
        # |A xor B| <= (1 - t) |A or B| and |A or B| <= min(|A|, |B|) / t
        self.differ = [(hi - 1) * (100 - percent) // percent for hi in lows[1:]]
        self.parts = [d + SHARED + -(-d * 7 // 20) for d in self.differ]

    def of(self, n: int) -> list[int]:
        """The bands whose sets may be the smaller one of a linked pair with a set of this size."""
        k = int(np.searchsorted(self.lows, n, side="right")) - 1
        least = -(-n * self.percent // 100)
        out = [k]
        while k and self.lows[k] - 1 >= least:
            k -= 1
            out.append(k)
        return [k for k in out if self.differ[k]]  # different sets differ in a shingle at least


def part_keys(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """Join keys of a sorted set of shingle hashes: one for each part and band that has to be joined.

    Two linked sets agree on parts - differ parts or more. A set leaves out its lightest parts, those with fewer
    shingles than a bound, as long as parts - differ - SHARED or fewer go. Of two linked sets take the one with
    the higher bound: at least SHARED of the parts they agree on are as heavy, and both emit those.
    """
    out = [np.zeros(0, np.uint64)]
    bits = mix((mix(shingles) >> np.uint64(64 - PART_BITS)) + np.uint64(0x5851F42D4C957F2D))
    for k in bands.of(len(shingles)):
        parts, spare = bands.parts[k], bands.parts[k] - bands.differ[k] - SHARED
        cuts = (np.arange(parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)
        starts = np.searchsorted(shingles, cuts)
        sizes = np.diff(np.append(starts, len(shingles)))
        sums = np.bitwise_xor.reduceat(bits, np.minimum(starts, len(bits) - 1))
        sums[sizes == 0] = 0
        lighter = np.cumsum(np.bincount(sizes, minlength=2))  # parts with at most so many shingles
        own = np.flatnonzero(sizes >= int(np.searchsorted(lighter, spare, side="right")))
        salt = np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)
        out.append(mix(mix(sums[own] + salt) + own.astype(np.uint64)))
    return np.concatenate(out)


def _sets(texts: list[str | None], hasher: WordHasher, width: int) -> list[np.ndarray]:
    words, counts = hasher.words(texts)
    hashes, n = windows(words, counts, width)
    return [np.unique(x) for x in np.split(hashes, np.cumsum(n)[:-1])]


def whole_sketch(shingles: np.ndarray) -> bytes:
    """The parity sketch of a set: a power of two of bits, twice its size or more. Halves XOR to the next shorter one."""
    bits = max(256, 1 << int(2 * len(shingles) - 1).bit_length()) if len(shingles) else 256
    flips = np.bincount((mix(shingles + np.uint64(7)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def _near(batches: Iterator[pa.RecordBatch], percent: int, best: bool) -> Iterator[pa.RecordBatch]:
    """From (cell, side, key, node, c, n, sketch), cells together, to pairs (key, a, b, far) with different c whose sketches allow a link.

    In a cell each node of side 0 meets each of side 1; with ``best`` it gives its nearest such partner alone.
    """

    def cell(rows: pa.Table) -> tuple[np.ndarray, ...]:
        node, c, n, side = (rows[x].to_numpy() for x in ("node", "c", "n", "side"))
        raw = rows["sketch"].to_pylist()
        least = min(map(len, raw))
        words = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, least // 8), axis=0) for x in raw])
        most, own, other = n * (100 - percent) // percent, np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        far = np.zeros((len(own), len(other)), np.int32)
        for w in range(words.shape[1]):
            far += np.bitwise_count(words[own, w, None] ^ words[None, other, w])
        fits = (far <= np.minimum(most[own, None], most[None, other])) & (c[own, None] != c[None, other])
        if best and far.size:
            far[~fits] = 1 << 30
            y = far.argmin(1)
            x = np.flatnonzero(far[np.arange(len(own)), y] < 1 << 30)
            y = y[x]
        else:
            x, y = np.nonzero(fits)
        return rows["key"].to_numpy()[own[x]], node[own[x]], node[other[y]], far[x, y].astype(np.int64)

    held: list[pa.RecordBatch] = []

    def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        cells = rows["cell"].to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1], [True]]))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cell(rows.slice(lo, hi - lo))], ["key", "a", "b", "far"])

    for batch in batches:
        if batch.num_rows:
            if held and batch.column(0)[batch.num_rows - 1] != held[-1].column(0)[0]:
                rows = pa.Table.from_batches([*held, batch])
                cells = rows["cell"].to_numpy()
                whole = int(np.flatnonzero(cells != cells[-1])[-1]) + 1
                yield from settle(rows.slice(0, whole))
                held = rows.slice(whole).combine_chunks().to_batches()
            else:
                held.append(batch)
    if held:
        yield from settle(pa.Table.from_batches(held))


def _cells(large: DataFrame, about: DataFrame) -> DataFrame:
    """The nodes of large buckets dealt out to cells of about BLOCK by BLOCK nodes.

    Only nodes outside a bucket's main component have to meet anyone: their blocks (side 0) meet the blocks of all its
    nodes (side 1), each pair of blocks in a cell of its own, wherever that is computed.
    """
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    block = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
    rows = large.join(about, "node")
    one = rows.where("c <> main").select("*", F.lit(0).alias("side"), block("rest").alias("r"), F.explode(F.sequence(F.lit(0), blocks("size") - 1)).alias("x"))
    all_ = rows.select("*", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), blocks("rest") - 1)).alias("r"), block("size").alias("x"))
    both = one.unionByName(all_).select(F.xxhash64("key", "r", "x").alias("cell"), "side", "key", "node", "c", "n", "sketch")
    return both.repartition("cell").sortWithinPartitions("cell")


def _node(shingles: np.ndarray) -> int | None:
    """A 64-bit name of a set: equal sets, equal names."""
    if not len(shingles):
        return None
    return int(mix(np.bitwise_xor.reduce(mix(shingles + np.uint64(1)))[None] + np.uint64(len(shingles))).view(np.int64)[0])


def _each(docs: DataFrame, schema: str, rows) -> DataFrame:
    """Hash the texts of ``docs`` (its last column) once per task and pass each batch with its sets to ``rows``."""

    def run(batches: Iterator[pa.RecordBatch], at: int, width: int) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(), set()
        for whole in batches:
            for part in slices(whole, at):
                batch = rows.wanted(part)
                yield rows(batch, _sets(batch.column(at).to_pylist(), hasher, width), seen)

    at, width = len(docs.columns) - 1, rows.width
    return docs.mapInArrow(lambda b: run(b, at, width), schema)


class _Rows:
    """What a pass over the texts yields for a batch; ``wanted`` may thin the batch out first."""

    def __init__(self, width: int):
        self.width = width

    def wanted(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch


class _Nodes(_Rows):
    """id, n_shingles, node, sketch."""

    def __call__(self, batch, sets, seen):
        nodes = pa.array([_node(s) for s in sets], pa.int64())
        sketches = pa.array([whole_sketch(s) for s in sets], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), nodes, sketches], ["doc_id", "n_shingles", "node", "sketch"])


class _Parts(_Rows):
    """node and its join keys, once per task."""

    def __init__(self, width: int, percent: int):
        super().__init__(width)
        self.bands = Bands(percent)

    def __call__(self, batch, sets, seen):
        nodes, keys = [], []
        for s in sets:
            if len(s) and (node := _node(s)) not in seen:
                seen.add(node)
                nodes.append(node)
                keys.append(part_keys(s, self.bands).view(np.int64))
        ends = np.concatenate([[0], np.cumsum([len(k) for k in keys], dtype=np.int64)]).astype(np.int32)
        flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(ends, flat)], ["node", "keys"])


class _Wanted(_Rows):
    """node and its set, once per task, of the documents whose bit a bitmap holds."""

    def __init__(self, width: int, bitmap):
        super().__init__(width)
        self.bitmap = bitmap

    def wanted(self, batch):
        bit = batch.column(0).to_numpy() & ((1 << BITMAP_BITS) - 1)
        there = (self.bitmap.value[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)
        return batch.take(pa.array(np.flatnonzero(there)))

    def __call__(self, batch, sets, seen):
        nodes, out = [], []
        for s in sets:
            if len(s) and (node := _node(s)) not in seen:
                seen.add(node)
                nodes.append(node)
                out.append(s.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(out, pa.binary())], ["node", "shingles"])


def bitmap_of(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits with those of ``key`` set: at most 2**(bits - 6) rows reach the driver, whatever the input."""
    bit = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    words = keys.select(F.shiftright(bit, 6).alias("w"), F.expr(f"shiftleft(1L, cast({key} & 63L AS int))").alias("v")).groupBy("w").agg(F.bit_or("v").alias("v"))
    rows = words.toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["w"].to_numpy(np.int64)] = rows["v"].to_numpy(np.int64).view(np.uint64)
    return out


def _judged(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, left, right = (c.to_pylist() for c in batch.columns)
        linked = np.zeros(len(a), bool)
        for k, (x, y) in enumerate(zip(left, right, strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked[k] = 100 * both >= percent * (len(x) + len(y) - both)
        keep = np.flatnonzero(linked)
        yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(keep)) for i in (0, 1)], ["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose sets link. The set of a node is hashed anew from one of its documents."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sources = nodes.groupBy("node").agg(F.xxhash64(F.min(F.expr(_ID))).alias("bit")).join(ends, "node")
    held = pairs.sparkSession.sparkContext.broadcast(bitmap_of(sources, "bit", BITMAP_BITS))
    sets = _each(texts.select(F.xxhash64(F.expr(_ID)).alias("bit"), texts.columns[-1]), "node long, shingles binary", _Wanted(width, held))
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    joined = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "sa", "sb")
    return joined.mapInArrow(lambda b: _judged(b, percent), "a long, b long").distinct()


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, text: str = "text") -> DataFrame:
    """doc_id, n_shingles (size of its set of ``width``-word shingles) and component_id of each row of ``docs``.

    Two documents link if 100 * intersection >= ``percent`` * union. component_id is the smallest doc_id that
    links reach, the document's own included. Equal sets are one node (named by a 64-bit hash) throughout, so
    copies are never expanded. One row per input row; other columns of ``docs`` are not read. A null or empty text
    or one without words has no shingles and links with nothing: its component is its doc_id. A null doc_id
    never becomes a component_id, so a component of such rows alone has a null one; rows that repeat a doc_id
    stay rows of their own. Texts are hashed whole; a very long one is alone in its slice, and its set of hashes is one
    row. An empty table stays empty.

    Candidates come from a shuffle of part keys. The first round tests each node against the node with which it
    shares most parts as the first of their bucket; the others test what is left, pairs that
    share buckets but not yet a component: in large buckets only those whose sketches allow a link, first the
    nearest partner of each node, then all. Only these become rows. Within a large bucket the sets outside its main
    component, r of m, are compared with all, r * m comparisons dealt out to cells of BLOCK by BLOCK sets.
    """
    light_batches(docs.sparkSession)
    texts = docs.select("doc_id", text)
    nodes = cut(_each(texts, "doc_id long, n_shingles long, node long, sketch binary", _Nodes(width)))
    keyed = _each(texts, "node long, keys array<long>", _Parts(width, percent)).select("node", F.explode("keys").alias("key"))
    bucket = W.partitionBy("key")
    shared = keyed.withColumns({"lo": F.min("node").over(bucket), "hi": F.max("node").over(bucket)}).where("lo < hi").select("key", "node", F.col("lo").alias("first")).distinct()
    shared = cut(shared)

    tries = shared.where("node <> first").groupBy("node", "first").count().where(F.col("count") >= SHARED)
    best = W.partitionBy("node").orderBy(F.desc("count"), "first")
    tries = cut(tries.withColumn("k", F.row_number().over(best)).where("k = 1").select(F.col("first").alias("a"), F.col("node").alias("b")))
    links = cut(_verified(tries, texts, nodes, width, percent))
    found = components(links)
    tried = tries.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    about = nodes.where("node IS NOT NULL").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    for best in (True, False):
        placed = shared.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
        per = placed.groupBy("key", "c").agg(F.count("*").alias("n"))
        main = F.max(F.struct("n", "c"))
        keys = per.groupBy("key").agg(F.sum("n").alias("size"), main["c"].alias("main"), (F.sum("n") - main["n"]).alias("rest")).where("rest > 0")
        split = cut(placed.join(keys, "key"))
        small, large = split.where(f"size <= {SMALL}"), split.where(f"size > {SMALL}")
        other = small.select("key", F.col("node").alias("b"), F.col("c").alias("d"))
        rest = small.withColumnRenamed("node", "a").join(other, "key").where("a < b AND c <> d").groupBy("a", "b").count().where(F.col("count") >= SHARED).select("a", "b")
        near = _cells(large, about).mapInArrow(lambda x, best=best: _near(x, percent, best), "key long, a long, b long, far long")
        if best:
            near = near.groupBy("key", "a").agg(F.min(F.struct("far", "b"))["b"].alias("b"))
        near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        rest = cut((rest.unionByName(near).distinct() if best else near).join(tried, ["a", "b"], "left_anti"))
        if rest.isEmpty():
            continue
        links = cut(links.unionByName(_verified(rest, texts, nodes, width, percent)))
        found, tried = components(links), tried.unionByName(rest)

    named = nodes.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least")).join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("c"))
    named = named.join(named.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("node", "component_id")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return nodes.join(named, "node", "left").select("doc_id", "n_shingles", own.alias("component_id"))


def op3_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document."""
    return jaccard_components(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * both_ >= 85 * (a.size + b.size - both_)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM reach r JOIN e ON r.b = e.x)
SELECT a AS doc_id, coalesce(any_value(n.size), 0) AS n_shingles, min(b) AS component_id FROM reach LEFT JOIN n ON n.doc_id = a GROUP BY a
"""
