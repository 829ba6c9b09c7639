"""64-bit hashes of the words of many texts at once, in numpy.

Words are runs of bytes other than \\x20 and \\x09-\\x0D, with A-Z lower-cased. A word's hash is a polynomial in
its bytes modulo 2**64, cut out of one running sum over the buffer, then mixed; it depends on the word alone.
"""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TO_BLANK = bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_BUFFER = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.cumprod(out, dtype=np.uint64)


class WordHasher:
    """Hashes words; keeps the powers of the base between calls."""

    def __init__(self):
        self.up, self.down = _powers(_BASE, _BUFFER + 2), _powers(_INVERSE, _BUFFER + 2)

    def _buffer(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(data, np.uint8)
        if len(raw) + 2 > len(self.up):  # one word longer than a buffer
            self.up, self.down = _powers(_BASE, len(raw) + 2), _powers(_INVERSE, len(raw) + 2)
        gap = np.ones(len(raw) + 2, bool)
        gap[1:-1] = _SPACE[raw]
        turn = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = turn[::2], turn[1::2]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=sums[1:])
        own = (sums[ends] - sums[starts]) * self.down[starts]
        return mix(own + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words, text after text, and how many words each text has."""
        hashes, counts = [], np.zeros(len(texts), np.int64)
        pending, first, size = [], 0, 0

        def flush(last: int) -> None:
            if not pending:
                return
            own, starts = self._buffer(b"\n".join(pending))
            edges = np.cumsum([len(p) + 1 for p in pending])
            counts[first:last] += np.bincount(np.searchsorted(edges, starts, side="right"), minlength=len(pending))
            hashes.append(own)
            pending.clear()

        for k, text in enumerate(texts):
            data = (text or "").encode()
            if size + len(data) > _BUFFER:
                flush(k)
                first, size = k, 0
            if len(data) > _BUFFER:
                data = data.translate(_TO_BLANK)
                while len(data) > _BUFFER and ((at := data.rfind(b" ", 0, _BUFFER)) >= 0 or (at := data.find(b" ", _BUFFER)) >= 0):
                    own, _ = self._buffer(data[:at])
                    hashes.append(own)
                    counts[k] += len(own)
                    data = data[at + 1 :]
            pending.append(data)
            size += len(data) + 1
        flush(len(texts))
        return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts


def windows(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words within a text, and how many each text has.

    A text of 1 to ``width`` - 1 words has one window, all its words.
    """
    starts = np.cumsum(counts) - counts
    n = np.maximum(counts - width + 1, (counts > 0).astype(np.int64))
    of = np.repeat(np.arange(len(counts)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - starts, n)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    full = np.minimum(counts, width)[of]
    total = full.astype(np.uint64)
    for k in range(width):
        part = padded[at + k] * np.uint64(2 * k + 0xA0761D6478BD642F) if k == 0 else mix(padded[at + k] + np.uint64(k))
        total = total * np.uint64(0xE7037ED1A0B428DB) + np.where(k < full, part, np.uint64(0))
    return mix(total), n
