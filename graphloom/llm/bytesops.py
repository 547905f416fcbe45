"""Whole-batch numpy work on UTF-8 text: words, word hashes, shingles.

Words are maximal runs of bytes outside {space, tab, LF, VT, FF, CR}, with A-Z
lowered.  A word's hash is a polynomial over a random byte table modulo 2**64
(two words collide with probability about 2**-64), then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)
_POW: list[np.ndarray] = []


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser; different salts give independent-looking values."""
    h = h ^ U((salt * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(n, CHUNK + 4096)
        inverse = pow(_BASE, -1, 1 << 64)
        _POW[:] = [np.concatenate(([U(1)], np.cumprod(np.full(size - 1, b, U), dtype=U))) for b in (_BASE, inverse)]
    return _POW[0], _POW[1]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, bounds, document of each segment); see pieces()."""
    for part, bounds, docs, _, _ in pieces(data, offsets, limit):
        yield part, bounds, docs


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK, reach: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool, np.ndarray]]:
    """(bytes, bounds, document of each segment, whether segments end their
    documents, the document's up to `reach` bytes before them), at most about
    `limit` bytes each.

    A longer document is cut after white space (or, in a word longer than the
    limit, after that word), so that no word is cut and memory stays bounded.
    """
    n, at, none = len(offsets) - 1, 0, data[:0]
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        begin, hi = offsets[at], offsets[end]
        lo = begin
        if hi - lo <= limit:
            yield data[lo:hi], offsets[at : end + 1] - lo, np.arange(at, end), True, none
        else:
            while lo < hi:
                cut = min(lo + limit, hi)
                while cut < hi:
                    gap = np.flatnonzero(SPACE[data[cut : min(cut + 65536, hi)]])
                    if len(gap):
                        cut += gap[0] + 1
                        break
                    cut = min(cut + 65536, hi)
                yield data[lo:cut], np.array([0, cut - lo]), np.array([at]), cut == hi, data[max(begin, lo - reach) : lo]
                lo = cut
        at = end


class Words:
    """Words of one chunk: start, end, segment and a prefix-sum hash."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        n = len(data)
        low = LOWER[data]
        word = np.zeros(n + 2, bool)
        word[1:-1] = ~SPACE[low]
        inner = bounds[(bounds > 0) & (bounds < n)]
        first = word[1:-1] & ~word[:-2]
        last = word[1:-1] & ~word[2:]
        first[inner] = word[1:-1][inner]
        last[inner - 1] = word[1:-1][inner - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.segment = np.searchsorted(bounds, self.starts, "right") - 1
        powers, self._inverse = _powers(n + 1)
        self._sums = np.zeros(n + 1, U)
        np.cumsum(_TABLE[low] * powers[:n], dtype=U, out=self._sums[1:])

    def hashes(self, upto: int | None = None) -> np.ndarray:
        """Hash of each word, or of its first `upto` bytes."""
        ends = self.ends if upto is None else np.minimum(self.ends, self.starts + upto)
        return mix((self._sums[ends] - self._sums[self.starts]) * self._inverse[self.starts], 0 if upto is None else upto)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document index of every word of a batch, in order."""
    found = [((w := Words(part, bounds)).hashes(), docs[w.segment]) for part, bounds, docs in chunks(data, offsets)]
    if not found:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate([h for h, _ in found]), np.concatenate([d for _, d in found])


def word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of each document."""
    out = np.zeros(len(offsets) - 1, np.int64)
    for part, bounds, docs in chunks(data, offsets):
        word = ~SPACE[part]
        first = word.copy()
        first[1:] &= ~word[:-1]
        inner = bounds[:-1][bounds[:-1] < len(part)]
        first[inner] = word[inner]
        total = np.concatenate(([0], np.cumsum(first)))
        out[docs] += np.diff(total[bounds])
    return out


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count), sorted; a text of fewer words is one shingle."""
    h, d = words(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(d, minlength=n)
    begin = np.concatenate(([0], np.cumsum(count)[:-1]))
    take = np.flatnonzero(d[: len(d) - width + 1] == d[width - 1 :]) if len(d) >= width else np.zeros(0, np.int64)
    s = np.zeros(len(take), U)
    for j in range(width):
        s = mix(s + h[take + j], j + 1)
    doc = d[take]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        tail = np.array([_fold(h[begin[i] : begin[i] + count[i]]) for i in short], U)
        s, doc = np.concatenate([s, tail]), np.concatenate([doc, short])
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], s[at], np.diff(np.append(at, len(s)))


def _fold(h: np.ndarray) -> np.uint64:
    out = np.zeros(1, U)
    for j in range(len(h)):
        out = mix(out + h[j : j + 1], 64 + j)
    return out[0]
