"""Removal of repeated byte strings by suffix sorting, deep and shallow.

A window is ``length`` bytes of a text. Every window has an anchor: the place of the least hash of its
``gram``-byte strings. Equal windows have equal anchor strings at equal places, so only windows that share an
anchor string need sorting. Neighbouring windows with one anchor form a stretch. Where an anchor string has
several stretches, their windows are sorted as suffixes: multikey quicksort on the first words, then blind tries
for those that still agree. Of stretches that are equal byte for byte one stands for all. The windows of very many
stretches around one anchor string are dealt out by how far before it they start, some neighbours at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm.common import cut, extended, light_batches, slices, table, without
from ravelin.llm.wordhash import _BASE, _INVERSE, _powers, mix

GRAM = 32
#: Bytes that multikey quicksort looks at before the blind tries take over.
SHALLOW = 24
#: Anchor strings with more stretches than this have these cut into parts that are sorted by cells, told by what their windows share.
HOT = 1000
#: Neighbouring windows of such a part at most: they share all of a window's bytes but one less than so many.
PART = 9
_TILE = 1 << 18
_PLACE_BITS = 20
#: Bits of a place (31 of start, 7 of the number of windows), and of a text's hash beside it.
_START_BITS, _LOW_BITS = 38, 25
#: Texts without anything to look up do not travel: they are told by a bitmap of so many bits.
FILTER_BITS = 24
_MAX_ID = (1 << 63) - 1
_CHUNK = 4 << 20


class Stretches:
    """Finds the stretches of texts: anchor key, stretch hash, start and number of windows."""

    def __init__(self, length: int):
        if not GRAM < length < GRAM + 127:
            raise ValueError(f"length must lie between {GRAM + 1} and {GRAM + 126}")
        self.length, self.width = length, length - GRAM + 1
        self.up, self.down = _powers(_BASE, _TILE + 4096), _powers(_INVERSE, _TILE + 4096)
        self.table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def keys(self, data: np.ndarray) -> np.ndarray:
        """The hash of the ``GRAM`` bytes from each place on."""
        gram = self.table[data]
        step, factor = 1, 0xC2B2AE3D27D4EB4F
        while step < GRAM:
            gram = gram[:-step] * np.uint64(factor) + gram[step:]
            step, factor = 2 * step, factor * factor % 2**64
        return mix(gram)

    def of(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """``data``: bytes; ``starts``: ascending places at which a whole window starts."""
        n = len(data)
        keys = self.keys(data)
        low = (keys & ~np.uint64((1 << _PLACE_BITS) - 1)) | np.arange(len(keys), dtype=np.uint64)
        step = 1
        while 2 * step <= self.width:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        rest = self.width - step
        low = np.minimum(low[: len(low) - rest], low[rest:])[starts]
        first = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (np.diff(starts) != 1)]))
        count = np.diff(np.append(first, len(starts)))
        start, anchor = starts[first], (low[first] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        own = (sums[start + count - 1 + self.length] - sums[start]) * self.down[start]
        shape = (anchor - start).astype(np.uint64) * np.uint64(128) + count.astype(np.uint64)
        return keys[anchor], mix(own + mix(shape)), start, count


def _tiles(texts: list[bytes], length: int) -> Iterator[tuple]:
    """Buffers of about a tile: its pieces (text, place in it, bytes), all bytes, the window starts and the pieces' starts."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def joined():
        ends = np.cumsum([len(p) for _, _, p in parts])
        base = ends - [len(p) for _, _, p in parts]
        n = np.array([len(p) - length + 1 for _, _, p in parts])
        starts = np.arange(int(n.sum())) + np.repeat(base - (np.cumsum(n) - n), n)
        return np.frombuffer(b"".join(p for _, _, p in parts), np.uint8), starts, base

    for k, data in enumerate(texts):
        for at in range(0, max(len(data) - length + 1, 0), _TILE):
            piece = data[at : at + _TILE + length - 1]
            if size + len(piece) > _TILE + length and parts:
                yield parts, *joined()
                parts, size = [], 0
            parts.append((k, at, piece))
            size += len(piece)
    if parts:
        yield parts, *joined()


def _alike(data: np.ndarray, one: np.ndarray, other: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the ``sizes`` bytes from ``one`` and from ``other`` on are equal, for each pair of places."""
    out = np.zeros(len(one), bool)
    by = np.argsort(sizes, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(sizes[by]) != 0, [True]])) if len(by) else np.zeros(1, np.int64)
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        n = int(sizes[by[lo]])
        for i in range(lo, hi, (1 << 22) // n):
            rows = by[i : min(hi, i + (1 << 22) // n)]
            within = np.arange(n)
            out[rows] = (data[one[rows, None] + within] == data[other[rows, None] + within]).all(1)
    return out


def _stretched(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """From (d, th, text) to (key, d, high, place, again).

    A place is a start and, in 7 bits, the number of windows less one. Here alone it is led by the low bits of th, whose
    high ones are ``high``: a row is most of what is shuffled.

    Equal stretches of a piece of input meet here already: all but the first are ``again``, after their bytes were
    compared, and get a key of their own so that a string which everyone has is dealt out like any other.
    """
    finder = Stretches(length)
    for batch in (part for whole in batches for part in slices(whole, 2, 32 << 20, 1 << 20)):
        if not batch.num_rows:
            continue
        d, th = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
        rows = []
        for parts, data, starts, base in _tiles(texts, length):
            key, own, start, count = finder.of(data, starts)
            part = np.searchsorted(base, start, side="right") - 1
            text = np.array([p[0] for p in parts])[part]
            place = start - base[part] + np.array([p[1] for p in parts])[part]
            rows.append((key, own, text, (place << 7) | (count - 1)))
        if not rows:
            continue
        key, own, text, place = (np.concatenate(x) for x in zip(*rows, strict=True))
        by = np.lexsort((place, th[text], d[text], own, key))
        key, own, text, place = key[by], own[by], text[by], place[by]
        alike = np.concatenate([[False], (key[1:] == key[:-1]) & (own[1:] == own[:-1])])
        first = np.maximum.accumulate(np.where(alike, 0, np.arange(len(key))))
        ids, names = d[text], th[text]
        alike &= (ids != ids[first]) | (names != names[first]) | (place != place[first])  # a repeated row is no earlier one
        at = np.flatnonzero(alike & ((place & 127) == (place[first] & 127)))
        whole = np.frombuffer(b"".join(texts), np.uint8)
        base = np.cumsum([0, *map(len, texts[:-1])])[text] + (place >> 7)
        again = np.zeros(len(key), bool)
        again[at] = _alike(whole, base[at], base[first[at]], (place[at] & 127) + length)
        key = np.where(again, mix(key + mix(ids.view(np.uint64) + mix(names.view(np.uint64) + mix(place.view(np.uint64))))), key)
        low = names & ((1 << _LOW_BITS) - 1)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids), pa.array(names >> _LOW_BITS), pa.array((low << _START_BITS) | place), pa.array(again)], ["key", "d", "high", "place", "again"])


def deep_shallow(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort the suffixes at ``starts`` by their first ``length`` bytes.

    Returns the order (indices into ``starts``) and, for each place of it, whether the suffix equals the one
    before. Ties stand in the order given. Every suffix has at least ``length`` bytes.
    """
    n = len(starts)
    padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
    word = np.zeros(len(data) + 8, np.uint64)
    for k in range(8):  # the eight bytes from each place on, the first the highest
        word |= padded[k : k + len(word)] << np.uint64(56 - 8 * k)

    def words(at: np.ndarray, depth: int) -> np.ndarray:
        own = word[at + depth]
        return own if depth + 8 <= length else own >> np.uint64(8 * (depth + 8 - length)) << np.uint64(8 * (depth + 8 - length))

    order, same = np.arange(n), np.zeros(n, bool)
    slots, group = np.arange(n), np.zeros(n, np.int64)  # the places not settled yet, and the group of each
    depth, shallow = 0, min(SHALLOW, length)
    while depth < shallow and len(slots):  # multikey quicksort: each pass splits the groups by the next word
        own = words(starts[order[slots]], depth)
        by = np.lexsort((own, group)) if depth else np.argsort(own, kind="stable")
        order[slots], own, group = order[slots][by], own[by], group[by]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (group[1:] != group[:-1])])
        depth += 8
        slots, group = _several(slots, new)
    if depth >= length:
        same[slots] = np.concatenate([[False], group[1:] == group[:-1]])[: len(slots)]
        return order, same
    if len(slots):
        tries = BlindTries(word, starts[order[slots]], group, words, shallow, length)
        place, same[slots] = tries.order()
        order[slots] = order[slots][place]
    return order, same


class BlindTries:
    """A blind trie for each group of suffixes that agree on their first bytes, all groups at once.

    A branch tells the bit at which its two sides part; what lies before that bit is skipped on the way down. Each
    suffix goes down blind to some leaf, is compared with that suffix once, and so learns the bit at which it
    leaves the trie; a branch for that bit goes in above the first one that tells a later bit. Branches are
    numbers from 0 on, leaves -1 - (number of the suffix); equal suffixes share a leaf.
    """

    def __init__(self, word: np.ndarray, at: np.ndarray, group: np.ndarray, words, shallow: int, length: int):
        self.word, self.at, self.words, self.shallow, self.length = word, at, words, shallow, length
        n = len(at)
        self.first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(self.first, n))
        self.root = -1 - self.first
        self.bit, self.sides, self.size = np.zeros(n, np.int64), np.zeros((2, n), np.int64), np.zeros(n, np.int64)
        self.leaf, self.rank, self.alike = np.arange(n), np.zeros(n, np.int64), np.ones(n, np.int64)
        self.used = 0
        for turn in range(1, int(sizes.max())):  # the next suffix of every group that has one
            tries = np.flatnonzero(sizes > turn)
            self._insert(tries, self.first[tries] + turn)

    def _bit_of(self, suffix: np.ndarray, bit: np.ndarray) -> np.ndarray:
        return ((self.word[self.at[suffix] + (bit >> 6) * 8] >> (63 - (bit & 63)).astype(np.uint64)) & np.uint64(1)).astype(np.int64)

    def _parting(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The first bit at which two suffixes differ; behind the last one if they are equal."""
        out, left = np.full(len(one), self.length * 8), np.arange(len(one))
        for depth in range(self.shallow, self.length, 8):
            gap = self.words(self.at[one[left]], depth) ^ self.words(self.at[other[left]], depth)
            some = gap != 0
            if some.any():
                x = gap[some]
                high = (x >> np.uint64(32)).astype(np.int64)
                half = np.where(high > 0, high, (x & np.uint64(0xFFFFFFFF)).astype(np.int64))
                out[left[some]] = depth * 8 + np.where(high > 0, 32, 64) - np.frexp(half.astype(np.float64))[1]
                left = left[~some]
                if not len(left):
                    break
        return out

    def _insert(self, tries: np.ndarray, suffix: np.ndarray) -> None:
        node = self.root[tries]
        down = np.flatnonzero(node >= 0)
        while len(down):  # blind: only the bits that branches tell are looked at
            on = node[down]
            node[down] = self.sides[self._bit_of(suffix[down], self.bit[on]), on]
            down = down[node[down] >= 0]
        found = -1 - node
        bit = self._parting(suffix, found)
        node, above, side = self.root[tries], np.full(len(tries), -1), np.zeros(len(tries), np.int64)
        down = np.flatnonzero(node >= 0)
        down = down[self.bit[node[down]] < bit[down]]
        while len(down):  # once more, to the place of the new branch or leaf
            on = node[down]
            self.size[on] += 1
            above[down], side[down] = on, self._bit_of(suffix[down], self.bit[on])
            node[down] = self.sides[side[down], on]
            down = down[node[down] >= 0]
            down = down[self.bit[node[down]] < bit[down]]
        equal = bit == self.length * 8
        self.leaf[suffix[equal]], self.rank[suffix[equal]] = found[equal], self.alike[found[equal]]
        self.alike[found[equal]] += 1
        new = np.flatnonzero(~equal)
        branch = self.used + np.arange(len(new))
        self.used += len(new)
        own = self._bit_of(suffix[new], bit[new])
        self.bit[branch], self.size[branch] = bit[new], 1 + self._sizes(node[new])
        self.sides[own, branch], self.sides[1 - own, branch] = -1 - suffix[new], node[new]
        top = above[new] < 0
        self.root[tries[new[top]]] = branch[top]
        self.sides[side[new[~top]], above[new[~top]]] = branch[~top]

    def _sizes(self, node: np.ndarray) -> np.ndarray:
        return np.where(node >= 0, self.size[np.maximum(node, 0)], self.alike[np.maximum(-1 - node, 0)])

    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes from left to right, trie by trie, and whether each equals the one before."""
        place = np.zeros(len(self.at), np.int64)
        node, begin = self.root, self.first.astype(np.int64)
        while len(node):
            leaf = node < 0
            place[-1 - node[leaf]] = begin[leaf]
            node, begin = node[~leaf], begin[~leaf]
            left = self.sides[0, node]
            node, begin = np.concatenate([left, self.sides[1, node]]), np.concatenate([begin, begin + self._sizes(left)])
        place = place[self.leaf] + self.rank
        out, same = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        out[place], same[place] = np.arange(len(place)), self.rank > 0
        return out, same


def _several(slots: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots of groups with two or more members, and their group numbers; ``new`` marks each first member."""
    group = np.cumsum(new) - 1
    many = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)
    return slots[many], group[many]


def repeats(texts: list[bytes], d: np.ndarray, th: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows, in these stretches, that equal an earlier one: stretch, first window, number of windows."""
    by = np.lexsort((place, th, d))
    by = by[np.concatenate([[True], (np.diff(place[by]) != 0) | (np.diff(th[by]) != 0) | (np.diff(d[by]) != 0)])]  # repeated rows
    texts, count = [texts[i] for i in by], (place[by] & 127) + 1
    base = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]]).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), count)
    within = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    order, same = deep_shallow(np.frombuffer(b"".join(texts), np.uint8), base[of] + within, length)
    first = np.flatnonzero(~same)
    earliest = np.minimum.reduceat(order, first) if len(order) else order  # windows stand in the order of the input
    later = order != np.repeat(earliest, np.diff(np.append(first, len(order))))
    hit = np.sort(order[later])
    head = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (of[hit][1:] != of[hit][:-1])])) if len(hit) else hit
    return by[of[hit[head]]], within[hit[head]], np.diff(np.append(head, len(hit)))


def _dealt(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """From (key, d, th, place, stretch) to parts of the same form, with ``told``: the bytes that a part's windows share.

    A part is the windows that start between a multiple of PART bytes before the anchor and the next. What all windows
    from there on that hold the anchor share is as long, and lies as far from it, in every stretch; so equal windows are
    in parts told by equal bytes.
    """
    finder = Stretches(length)
    for batch in (part for whole in batches for part in slices(whole, 4, _CHUNK, 1 << 20)):
        if not batch.num_rows:
            continue
        key, place = batch.column(0).to_numpy().view(np.uint64), batch.column(3).to_numpy()
        texts = batch.column(4).to_pylist()
        sizes = np.array([len(t) for t in texts])
        whole, base = b"".join(texts), np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(texts)), sizes)[: len(whole) - GRAM + 1]
        at = np.flatnonzero(finder.keys(np.frombuffer(whole, np.uint8)) == key[of])  # the first one of a stretch is its anchor
        anchor = at[np.searchsorted(at, base)] - base
        count = (place & 127) + 1
        of = np.repeat(np.arange(len(texts)), count)
        within = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        turn = (anchor[of] - within) // PART
        head = np.flatnonzero(np.concatenate([[True], (turn[1:] != turn[:-1]) | (of[1:] != of[:-1])]))
        n = np.diff(np.append(head, len(of)))
        own, start, least = of[head], within[head], turn[head] * PART
        most = np.minimum(least + PART, finder.width) - 1
        cut_ = lambda begin, size: pa.array([whole[a : a + k] for a, k in zip((base[own] + begin).tolist(), size.tolist(), strict=True)], pa.binary())
        rows = batch.take(pa.array(own))
        places = pa.array((((place[own] >> 7) + start) << 7) | (n - 1))
        told = cut_(anchor[own] - least, length - most + least)
        yield pa.RecordBatch.from_arrays([*rows.columns[:3], places, cut_(start, n - 1 + length), told], [*batch.schema.names, "told"])


def _sorted(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """From (key, d, th, place, stretch), keys together, to the runs (d, th, start, bytes)."""
    held: list[pa.RecordBatch] = []
    size = 0

    def settle(rows: pa.Table) -> pa.RecordBatch:
        """Of stretches equal byte for byte under one key all but the earliest repeat; the windows of the others are sorted."""
        key, d, th, place = (rows[c].to_numpy() for c in ("key", "d", "th", "place"))
        of = rows["stretch"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        by = np.lexsort((place, th, d, of, key))
        new = np.concatenate([[True], (key[by][1:] != key[by][:-1]) | (of[by][1:] != of[by][:-1])])
        first = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
        again = by[~new & ((d[by] != d[first]) | (th[by] != th[first]) | (place[by] != place[first]))]
        own = np.sort(by[new])
        which, begin, n = repeats(rows["stretch"].take(pa.array(own)).to_pylist(), d[own], th[own], place[own], length)
        which, begin, n = np.concatenate([own[which], again]), np.concatenate([begin, np.zeros(len(again), np.int64)]), np.concatenate([n, (place[again] & 127) + 1])
        return pa.RecordBatch.from_arrays([pa.array(d[which]), pa.array(th[which]), pa.array((place[which] >> 7) + begin), pa.array(n + length - 1)], ["d", "th", "start", "bytes"])

    for batch in (part for whole in batches for part in slices(whole, 4, _CHUNK, 1 << 20)):
        held.append(batch)
        size += batch.nbytes
        if size > _CHUNK and held[0].column(0)[0] != batch.column(0)[batch.num_rows - 1]:  # all but the last key are whole
            rows = pa.Table.from_batches(held)
            whole = int(np.searchsorted(rows["key"].to_numpy(), batch.column(0)[batch.num_rows - 1].as_py()))
            yield settle(rows.slice(0, whole))
            held = rows.slice(whole).combine_chunks().to_batches()
            size = sum(b.nbytes for b in held)
    if held:
        yield settle(pa.Table.from_batches(held))


def _kept(batches: Iterator[pa.RecordBatch], at: int, length: int, names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Cut the spans (last column: start and bytes, in no order) out of the texts in column ``at``."""
    for batch in (part for whole in batches for part in slices(whole, at, 32 << 20, 1 << 20)):
        kept, removed, spans = [], [], []
        for text, runs in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            data, own, end = (text or "").encode(), [], -1
            for run in sorted((r["start"], r["start"] + r["bytes"]) for r in runs or ()):
                if own and run[0] <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], run[1])
                else:
                    own.append([*run])
            pieces, end = [], 0
            for a, b in own:
                pieces.append(data[end:a])
                end = b
            kept.append(b"".join([*pieces, data[end:]]))
            removed.append(sum(b - a for a, b in own))
            spans.append([{"start": a, "bytes": b - a} for a, b in own])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("bytes", pa.int64())]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, kind)], [*batch.schema.names[:-1], *names])


def _marked(keyed: DataFrame, own: DataFrame) -> DataFrame:
    """``keyed`` with there_, false only if (d_, th_) is not in ``own``: a bitmap of 2**FILTER_BITS bits, broadcast as that many / 64 rows or fewer."""
    bit = F.xxhash64("d_", "th_").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = own.select(bit.alias("b")).select(F.shiftright("b", 6).alias("w_"), F.expr("shiftleft(1L, cast(b & 63L AS int))").alias("v")).groupBy("w_").agg(F.bit_or("v").alias("v_"))
    marked = keyed.withColumns({"w_": F.shiftright(bit, 6), "at_": bit.bitwiseAND(F.lit(63)).cast("int")}).join(F.broadcast(words), "w_", "left")
    return marked.withColumn("there_", F.expr("coalesce(shiftrightunsigned(v_, at_) & 1L, 0L) = 1L")).drop("w_", "at_", "v_")


def remove_repeats(docs: DataFrame, length: int = 100, text: str = "text") -> DataFrame:
    """``docs`` with kept (the remaining bytes), n_removed and spans (start, bytes) of what was removed.

    A byte goes if a ``length``-byte string that also starts earlier covers it: in a row with a smaller doc_id, or
    earlier in the same row. Strings are judged on the input and never cross rows. A null text counts as empty;
    texts shorter than ``length`` stay whole. Null ids come last. Rows that repeat a doc_id are ordered by a 57-bit
    hash of their texts; rows equal in both count as one document and share its result. One row per input row; columns
    of these names are replaced. An anchor string with more than HOT stretches is sorted in cells: its stretches
    are cut into parts of PART windows or fewer, at places that the anchor fixes, and a cell is told by the bytes that
    the windows of its parts share, all but PART - 1; equal windows are in one cell, so the result is the same. Tasks
    hold one piece of input, or the windows of one cell.
    """
    light_batches(docs.sparkSession)
    docs = without(docs, "kept", "n_removed", "spans", "d_", "th_")
    keyed = docs.withColumns({"d_": F.coalesce(F.col("doc_id").cast("long"), F.lit(_MAX_ID)), "th_": F.shiftrightunsigned(F.xxhash64(text), 64 - 32 - _LOW_BITS)})
    stretches = keyed.select("d_", "th_", text).mapInArrow(lambda b: _stretched(b, length), "key long, d long, high long, place long, again boolean")
    seen = stretches.withColumn("n", F.count("*").over(W.partitionBy("key"))).where("again OR n > 1")
    seen = seen.select("key", "d", F.shiftleft("high", _LOW_BITS).bitwiseOR(F.shiftright("place", _START_BITS)).alias("th"), F.col("place").bitwiseAND(F.lit((1 << _START_BITS) - 1)).alias("place"), "again", "n")
    by_doc = cut(
        seen.groupBy("d", "th").agg(
            F.collect_list(F.when(F.col("again"), F.col("place"))).alias("again"),
            F.collect_list(F.when(~F.col("again"), F.struct("key", "place", (F.col("n") > HOT).alias("hot")))).alias("open"),
        )
    )
    run = lambda p: F.struct(F.shiftright(p, 7).alias("start"), (p.bitwiseAND(F.lit(127)) + length).alias("bytes"))
    own = by_doc.select(F.col("d").alias("d_"), F.col("th").alias("th_"), "open").where(F.size("open") > 0)
    held = _marked(keyed, own).where("there_").join(own, ["d_", "th_"])
    held = held.select(F.col("d_").alias("d"), F.col("th_").alias("th"), F.col(text).cast("binary").alias("data"), F.explode("open").alias("o"))
    held = held.select("o.key", "d", "th", "o.place", "data", run(F.col("o.place")).alias("s"), "o.hot")
    held = held.select("key", "d", "th", "place", F.substring("data", (F.col("s.start") + 1).cast("int"), F.col("s.bytes").cast("int")).alias("stretch"), "hot")
    cold = held.where("NOT hot").drop("hot")
    parts = held.where("hot").drop("hot").mapInArrow(lambda b: _dealt(b, length), "key long, d long, th long, place long, stretch binary, told binary")
    each = parts.select(F.xxhash64("key", "told").alias("key"), "d", "th", "place", "stretch")
    found = cold.unionByName(each).repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: _sorted(b, length), "d long, th long, start long, bytes long")
    runs = found.groupBy("d", "th").agg(F.collect_list(F.struct("start", "bytes")).alias("runs"))
    runs = runs.unionByName(by_doc.where(F.size("again") > 0).select("d", "th", F.transform("again", run).alias("runs")))
    runs = cut(runs.groupBy(F.col("d").alias("d_"), F.col("th").alias("th_")).agg(F.flatten(F.collect_list("runs")).alias("runs_")))
    marked = _marked(keyed, runs.select("d_", "th_"))
    joined = marked.where("there_").join(runs, ["d_", "th_"], "left").select(*docs.columns, "runs_")
    joined = joined.unionByName(marked.where("NOT there_").select(*docs.columns, F.lit(None).cast(runs.schema["runs_"].dataType).alias("runs_")))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("bytes", T.LongType())])
    schema = extended(docs, kept=T.BinaryType(), n_removed=T.LongType(), spans=T.ArrayType(span))
    column = docs.columns.index(text)
    return joined.mapInArrow(lambda b: _kept(b, column, length, ("kept", "n_removed", "spans")), schema)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document, digested."""
    docs = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, n - 99)) AS j FROM d WHERE n >= 100),
w AS (SELECT doc_id, j, row_number() OVER (PARTITION BY md5_number(h[j + 1:j + 100]) ORDER BY doc_id, j) AS k FROM p),
hit AS (SELECT doc_id, j, CASE WHEN j <= lag(j) OVER (PARTITION BY doc_id ORDER BY j) + 100 THEN 0 ELSE 1 END AS opens FROM w WHERE k > 1),
grp AS (SELECT doc_id, j, sum(opens) OVER (PARTITION BY doc_id ORDER BY j) AS g FROM hit),
run AS (SELECT doc_id, min(j) AS a, max(j) + 100 AS b FROM grp GROUP BY doc_id, g),
gap AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM run
  UNION ALL SELECT d.doc_id, coalesce(max(b), 0), any_value(n) FROM d LEFT JOIN run USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT g.doc_id, sha256(unhex(string_agg(CASE WHEN e > s THEN hex(h[s + 1:e]) ELSE '' END, '' ORDER BY s))) AS kept_sha256 FROM gap g JOIN d USING (doc_id) GROUP BY g.doc_id),
cut AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM run GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)
"""
