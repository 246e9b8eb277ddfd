"""Vectorised helpers shared by the operators: they run inside Spark tasks on
Arrow batches and treat the texts of a batch as one byte array.

A-Z are folded through a byte table.  Both word patterns of the package are
byte-exact, because every byte of a non-ASCII code point is >= 0x80:

* ``ALNUM``:    ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after folding
* ``NONSPACE``: ``[^\\x20\\x09-\\x0D]+``

Hashes are 64-bit polynomial hashes finished by a mixing step; equal hashes are
taken as equal content only where the caller says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[9:14] = NONSPACE[32] = False

_BASE = {0: 0x9E3779B97F4A7C15 | 3, 1: 0xD1342543DE82EF95 | 3}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array (null: empty) and its row offsets from 0."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    raw = pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = texts.fill_null(b"" if raw else "")
    texts = texts.cast(pa.large_binary() if raw else pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: int = 1,
           max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows of about ``max_bytes`` of text (a longer
    text stays whole), so that a task's working memory follows its longest text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = flat(batch.column(text))[1]
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + max_bytes, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def mix(h: np.ndarray) -> np.ndarray:
    """Finishing step that spreads every input bit over the 64 bits."""
    shifted = h >> U(30)
    h = h ^ shifted
    h *= U(0xBF58476D1CE4E5B9)
    np.right_shift(h, U(27), out=shifted)
    h ^= shifted
    h *= U(0x94D049BB133111EB)
    np.right_shift(h, U(31), out=shifted)
    h ^= shifted
    return h


def _powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(seed)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        base = _BASE[seed] & 0xFFFFFFFFFFFFFFFF
        inverse = pow(base, -1, 1 << 64)
        up = np.full(size, base, dtype=U)
        down = np.full(size, inverse, dtype=U)
        up[0] = down[0] = 1
        _POWERS[seed] = have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of ``values[s:e]`` for every span; equal sequences get equal hashes."""
    up, down = _powers(len(values) + 1, seed)
    sums = np.empty(len(values) + 1, dtype=U)
    sums[0] = 0
    np.cumsum((values.astype(U) + U(1)) * up[:len(values)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(U) * U(0xA0761D6478BD642F))


def gram_hashes(values: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of ``values[i:i + width]`` for every i that has one (not that of ``span_hashes``)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    up, down = _powers(len(values), seed)
    sums = np.empty(len(values) + 1, dtype=U)
    sums[0] = 0
    terms = values.astype(U)
    terms += U(1)
    terms *= up[:len(values)]
    np.cumsum(terms, out=sums[1:])
    h = sums[width:] - sums[:n]
    h *= down[:n]
    return mix(h)


def words(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and each row's offset among them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = table[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = at[:-1][at[1:] > at[:-1]]
    first[full] = inside[full]
    full = at[1:][at[1:] > at[:-1]] - 1
    last[full] = inside[full]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all runs ``starts[i] : starts[i] + sizes[i]``, one run after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def row_of(at: np.ndarray) -> np.ndarray:
    """The row of every item, from the rows' offsets."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def sliding_first_min(values: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` values: the index of its leftmost smallest one
    (values are compared without their low bits, which carry the index)."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64)
    bits = U(max(22, int(n).bit_length()))
    low = (U(1) << bits) - U(1)
    cur = (values & ~low) | np.arange(n, dtype=U)
    span = 1
    while span * 2 <= width:
        cur = np.minimum(cur[:-span], cur[span:])
        span *= 2
    rest = width - span
    if rest:
        cur = np.minimum(cur[:-rest], cur[rest:])
    return (cur & low).astype(np.int64)


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in one of the spans."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def as_long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def lists(values: pa.Array, at: np.ndarray) -> pa.Array:
    """Rows of a list column from flat values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)
