"""Vectorised tokenising and hashing of whole Arrow text columns.

A text column is read as one UTF-8 buffer with row offsets.  Tokens are the maximal runs of bytes
of one class, and a class table says which bytes are blank (class 0).  Every token gets a 64-bit
hash: a polynomial over random 64-bit byte codes, modulo 2**64, read off one prefix sum and then
mixed.  Nothing here loops over rows or tokens in Python, and memory is bounded by the batch.

Defined cases: null text counts as the empty text; an empty or blank text has no tokens; a token
never crosses a row boundary; a token of any length is hashed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes worked on at a time, so that the temporary arrays stay in cache.
WINDOW = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20240229))
_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)

#: Blank bytes of the word rule `[^\x20\x09-\x0D]+`: class 0, all others class 1.
SPACE_CLASSES = np.ones(256, np.uint8)
SPACE_CLASSES[[9, 10, 11, 12, 13, 32]] = 0

#: ASCII letters, digits and all bytes of longer characters: class 1; other visible bytes: class 2.
SHAPE_CLASSES = np.full(256, 2, np.uint8)
SHAPE_CLASSES[[9, 10, 11, 12, 13, 32]] = 0
SHAPE_CLASSES[128:] = 1
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    SHAPE_CLASSES[_a:_b] = 1

#: As SHAPE_CLASSES, but punctuation is blank too.
LETTER_CLASSES = np.where(SHAPE_CLASSES == 1, 1, 0).astype(np.uint8)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLDED_CODES = _CODES[_FOLD]

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, WINDOW + 1)
        tables = []
        for b in (_BASE, _BASE_INV):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers[:] = tables
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, and n+1 offsets into them; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _windows(blank: np.ndarray, size: int):
    """Cuts at blanks, about WINDOW apart, so that no token is divided."""
    a = 0
    while a < size:
        b = min(a + WINDOW, size)
        if b < size:
            back = np.flatnonzero(blank[a:b])
            if len(back):
                b = a + int(back[-1]) + 1
            else:  # one token is longer than the window
                step = WINDOW
                while b < size:
                    ahead = np.flatnonzero(blank[b : b + step])
                    if len(ahead):
                        b += int(ahead[0]) + 1
                        break
                    b = min(size, b + step)
                    step *= 2
        yield a, b
        a = b


def token_spans(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every token in the buffer, in order."""
    kind = classes[data]
    edge = np.empty(len(kind), bool)
    if len(kind):
        edge[0] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:])
        inner = offsets[1:-1]
        edge[inner[inner < len(kind)]] = True
    cuts = np.flatnonzero(edge)
    ends = np.append(cuts[1:], len(kind))
    keep = kind[cuts] != 0
    return cuts[keep], ends[keep]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """The mixed hash of every span; spans are in order, do not overlap and are cut by `blank` bytes."""
    out = np.empty(len(starts), np.uint64)
    for a, b in _windows(blank, len(data)):
        i, j = np.searchsorted(starts, (a, b))
        if i == j:
            continue
        up, down = _power_tables(b - a)
        sums = np.empty(b - a + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_FOLDED_CODES[data[a:b]] * up[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
    return mix(out)


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending."""
    v = np.sort(values)
    return v[np.concatenate(([True], v[1:] != v[:-1]))] if len(v) else v


def token_hashes(column: pa.Array, classes: np.ndarray = SPACE_CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a column, A-Z folded to a-z, and n+1 row offsets into them."""
    data, offsets = text_buffer(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts, ends = token_spans(data, offsets, classes)
    hashes = hash_spans(data, starts, ends, classes[data] == 0)
    return hashes, np.searchsorted(starts, offsets)


def combine(*parts: np.ndarray) -> np.ndarray:
    """One hash for several hashes in order."""
    h = parts[0]
    for p in parts[1:]:
        h = mix(h * np.uint64(0xD1342543DE82EF95) + p)
    return h


def row_of(ptr: np.ndarray) -> np.ndarray:
    """For every element of a ragged array with offsets `ptr`, the row that holds it."""
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def shingles(hashes: np.ndarray, ptr: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n tokens inside a row, in order; a row of 1 to n-1 tokens gives one
    shingle, its whole sequence; a row without tokens gives none."""
    sizes = np.diff(ptr)
    counts = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    out_ptr = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(out_ptr[-1], np.uint64)
    if len(hashes) >= n:
        runs = combine(*(hashes[k : len(hashes) - n + 1 + k] for k in range(n)))
        full = np.flatnonzero(sizes >= n)
        at = np.repeat(ptr[full] - out_ptr[full], counts[full]) + np.flatnonzero(np.repeat(sizes >= n, counts))
        out[np.repeat(sizes >= n, counts)] = runs[at]
    for row in np.flatnonzero((sizes > 0) & (sizes < n)):
        h = hashes[ptr[row] : ptr[row + 1]]
        short = h[:1]
        for k in range(1, len(h)):
            short = combine(short, h[k : k + 1])
        out[out_ptr[row]] = mix(short + np.uint64(len(h)))[0]
    return out, out_ptr


def distinct_by_row(values: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of every row of a ragged uint64 array."""
    if not len(values):
        return values, ptr
    pieces, sizes = [], np.zeros(len(ptr) - 1, np.int64)
    for i in range(len(ptr) - 1):
        if ptr[i] < ptr[i + 1]:
            v = np.sort(values[ptr[i] : ptr[i + 1]])
            keep = np.empty(len(v), bool)
            keep[0] = True
            np.not_equal(v[1:], v[:-1], out=keep[1:])
            v = v[keep]
            pieces.append(v)
            sizes[i] = len(v)
    return (np.concatenate(pieces) if pieces else values[:0]), np.concatenate(([0], np.cumsum(sizes)))
