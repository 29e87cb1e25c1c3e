"""Vectorised text kernels on code points, shared by the corpus operators.

A chunk of texts becomes one ``uint32`` array of code points and an array of
offsets. Hashes of any span come from prefix sums of ``c * B**i`` modulo 2**64,
so a shingle, a word or a line costs a constant number of array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LIM = 0x3400
_LUT: dict[str, np.ndarray] = {}
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []
#: Characters of text handled at once; keeps temporaries near the CPU caches.
CHUNK_CHARS = 400_000
#: Signs of white space that are trimmed from a line one by one.
TRIM = 16


def _table(name: str) -> np.ndarray:
    """A lookup table over the lower code points, built on first use."""
    if name not in _LUT:
        chars = [chr(i) for i in range(_LIM)]
        made = {
            "space": lambda: np.array([c.isspace() for c in chars]),
            "upper": lambda: np.array([c.isupper() for c in chars]),
            "alpha": lambda: np.array([c.isalpha() for c in chars]),
            "digit": lambda: np.array([c in "0123456789" for c in chars]),
            "lower": lambda: np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars], np.uint32),
        }
        _LUT[name] = made[name]()
    return _LUT[name]


def is_kind(codes: np.ndarray, kind: str) -> np.ndarray:
    """Mask of the code points of a kind; those beyond the table count as letters."""
    if kind == "space" and codes.dtype == np.uint32:  # below 128 by comparing; a lookup of every sign costs several times as much
        out = (codes == 32) | (codes - np.uint32(9) < 5) | (codes - np.uint32(28) < 4)
        rest = np.flatnonzero(codes >= 128)
        some = codes[rest]
        out[rest] = _table(kind)[np.where(some >= _LIM, 0, some)]
        return out
    high = codes >= _LIM
    out = _table(kind)[np.where(high, 0, codes)]
    if high.any():
        out = out.copy()
        out[high] = kind == "alpha"
    return out


def lower(codes: np.ndarray) -> np.ndarray:
    out = codes + ((codes - np.uint32(65) < 26).view(np.uint8) << np.uint8(5))
    rest = np.flatnonzero(codes >= 128)
    some = codes[rest]
    high = some >= _LIM
    out[rest] = np.where(high, some, _table("lower")[np.where(high, 0, some)])
    return out


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one after another, and their n+1 offsets."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * CHUNK_CHARS)
        inverse = pow(_BASE, -1, 1 << 64)
        made = []
        for base in (_BASE, inverse):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            made.append(np.cumprod(out))
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


class SpanHash:
    """Hash of any span of a code-point array in constant time."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        power, self._inverse = _powers(n + 1)
        self._sum = np.zeros(n + 1, np.uint64)
        own = codes.astype(np.uint64)
        own += np.uint64(1)
        own *= power[:n]
        np.cumsum(own, out=self._sum[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._inverse[start])

    def every(self, width: int) -> np.ndarray:
        """Hashes of all spans of a width, by their starts."""
        out = self._sum[width:] - self._sum[:-width]
        out *= self._inverse[: len(out)]
        return mix(out)


def split_words(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the white-space separated words, and word offsets per text."""
    solid = ~is_kind(codes, "space")
    return _spans(solid, offsets)


def _spans(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(solid)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] = solid[edge]
    last[edge - 1] = solid[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def split_lines(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trimmed start and end, text index and line number of every line that isn't blank."""
    n = len(codes)
    breaks = np.flatnonzero(codes == 10)
    begin = np.union1d(offsets[:-1], breaks + 1)
    begin = begin[begin < n]
    lo, hi = _trimmed(codes, begin, np.append(begin[1:], n))
    full = hi > lo
    begin, lo, hi = begin[full], lo[full], hi[full]
    text = np.searchsorted(offsets, begin, "right") - 1
    number = np.searchsorted(breaks, begin) - np.searchsorted(breaks, offsets[text])
    return lo, hi, text, number


def _trimmed(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without the white space about them; a blank one ends where it starts or before.

    Few spans have more than a sign or two to trim, so these are looked at one by
    one; only if a span has more than ``TRIM`` is every sign looked at.
    """
    lo, hi = begin.copy(), end.copy()
    for at, step in ((hi, -1), (lo, 1)):
        live = np.flatnonzero(hi > lo)
        for _ in range(TRIM):
            live = live[is_kind(codes[at[live] - (step < 0)], "space")]
            at[live] += step
            live = live[hi[live] > lo[live]]
            if not len(live):
                break
        else:
            solid = np.flatnonzero(~is_kind(codes, "space"))
            first, last = np.searchsorted(solid, begin), np.searchsorted(solid, end)
            lo, hi = end.copy(), end.copy()
            full = last > first
            lo[full], hi[full] = solid[first[full]], solid[last[full] - 1] + 1
            return lo, hi
    return lo, hi


def ragged(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions ``starts[i] + 0 .. lengths[i]-1`` in order, and the n+1 offsets."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths), offsets


def word_grams(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows of every text, with offsets; a shorter text is one window."""
    count = np.diff(offsets)
    windows = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    at, out = ragged(offsets[:-1], windows)
    width = np.repeat(np.minimum(count, n), windows)
    total = np.zeros(len(at), np.uint64)
    for k in range(n):
        here = width > k
        add = hashes[np.where(here, at + k, 0)] if len(hashes) else total
        total = np.where(here, (total ^ add) * np.uint64(0x9E6C63D0876A9A47) + np.uint64(k + 1), total)
    return mix(total), out


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = 0) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with about ``limit`` bytes of text each; null texts become ''.

    Only one slice's texts are Python strings at a time.
    """
    limit = limit or CHUNK_CHARS
    column = batch.column(batch.schema.get_field_index(text))
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin, done = 0, 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(begin, end - begin), [t or "" for t in column.slice(begin, end - begin).to_pylist()]
        begin, done = end, int(ends[end - 1])


def int_column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
