"""Words of UTF-8 texts as 64-bit hashes, for whole Arrow batches at once.

A word is a run of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z. All its delimiters are ASCII, so
words can be cut on bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE = 1 << 20  # bytes of text hashed at once; longer texts are cut between words


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def doc_slices(offs: np.ndarray, limit: int = SLICE):
    """Ranges (i, j) of consecutive documents of about limit bytes each; a longer document stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Hashes words; made once in a task."""

    def __init__(self) -> None:
        rng = np.random.default_rng(20240611)
        self.low = np.arange(256, dtype=np.uint8)
        self.low[65:91] += 32
        word = np.zeros(256, bool)
        word[48:58] = word[65:91] = word[97:123] = word[128:] = True
        self.word = word
        value = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.value = np.where(word, value[self.low], 0).astype(np.uint64)
        base = 0x9E3779B97F4A7C15
        with np.errstate(over="ignore"):
            self.pow = np.multiply.accumulate(np.full(2 * SLICE, base, np.uint64))
            self.inv = np.multiply.accumulate(np.full(2 * SLICE, pow(base, -1, 1 << 64), np.uint64))

    def _piece(self, data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(data)
        if n > len(self.pow):  # one word longer than a slice
            grow = n - len(self.pow)
            for name in ("pow", "inv"):
                a = getattr(self, name)
                more = np.full(grow, a[0], np.uint64)
                more[0] *= a[-1]
                setattr(self, name, np.concatenate([a, np.multiply.accumulate(more)]))
        w = self.word[data]
        before = np.zeros(n, bool)
        before[1:] = w[:-1]
        before[breaks[breaks < n]] = False
        starts = np.flatnonzero(w & ~before)
        after = np.zeros(n, bool)
        after[:-1] = w[1:]
        cut = breaks[(breaks > 0) & (breaks < n)] - 1
        after[cut] = False
        ends = np.flatnonzero(w & ~after) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[data] * self.pow[:n], out=total[1:])
        h = (total[ends] - total[starts]) * self.inv[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts, ends

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of documents offs[i]:offs[i + 1] in data: word hashes, starts, ends, and the n + 1 word offsets."""
        hs, ss, es = [], [], []
        a, n = 0, len(data)
        with np.errstate(over="ignore"):
            while a < n:
                b = min(n, a + SLICE)
                while b < n and self.word[data[b - 1]] and self.word[data[b]]:
                    gaps = np.flatnonzero(~self.word[data[b : b + SLICE]])
                    b = b + int(gaps[0]) if len(gaps) else min(n, b + SLICE)
                breaks = offs[np.searchsorted(offs, a) : np.searchsorted(offs, b)] - a
                h, s, e = self._piece(data[a:b], breaks)
                hs.append(h)
                ss.append(s + a)
                es.append(e + a)
                a = b
        h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
        s = np.concatenate(ss) if ss else np.zeros(0, np.int64)
        e = np.concatenate(es) if es else np.zeros(0, np.int64)
        return h, s, e, np.searchsorted(s, offs)
