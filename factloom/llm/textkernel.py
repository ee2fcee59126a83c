"""Vectorised byte kernels over Arrow string columns, shared by the text operators.

Everything here works on the raw UTF-8 buffer of a whole Arrow column at once: no Python string is made per
row.  A *word* is a maximal run of bytes outside ``{0x20, 0x09-0x0D}`` and never crosses a row.  Null and empty
texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)
_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_FOLDED = _BYTE[_LOWER]
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.int64).astype(U64) | U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Words are hashed in pieces of about so many bytes, whatever a row's length, so that working arrays stay small.
PIECE = 1 << 19
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= PIECE:  # a single word of more is not worth keeping a table for
            _powers[name] = have
    return have[:n]


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets (rows + 1) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not wide and not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column, wide = column.cast(pa.large_string()), True
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, most: int = 400_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``most`` bytes; a longer row is a run of its own."""
    data, off = as_bytes(column)
    row, n = 0, len(off) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + most, "right")) - 1)
        yield row, end, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (rows + 1)."""
    solid = ~_SEP[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    start[edges] = solid[edges]
    end[edges - 1] = solid[edges - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased first if ``fold``."""
    if not len(starts):
        return np.zeros(0, U64)
    if len(data) > PIECE and len(starts) > 1:
        edges = np.flatnonzero(np.diff(starts // PIECE)) + 1  # a piece's last word may be longer than the piece: it goes alone
        cuts = np.unique(np.concatenate([[0], edges - 1, edges, [len(starts) - 1, len(starts)]]))
        out = np.empty(len(starts), U64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            lo, hi = int(starts[a]), int(ends[b - 1])
            out[a:b] = _hash_words(data[lo:hi], starts[a:b] - lo, ends[a:b] - lo, fold)
        return out
    return _hash_words(data, starts, ends, fold)


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    with np.errstate(over="ignore"):
        run = (_BYTE_FOLDED if fold else _BYTE)[data]
        run *= _power(_MULT, "up", len(data))
        np.cumsum(run, out=run)
        total = run[ends - 1]
        before = np.where(starts > 0, run[np.maximum(starts, 1) - 1], U64(0))
        return mix((total - before) * _power(_INV, "down", len(data))[starts] + (ends - starts).astype(U64))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words of one long word sequence (row edges are the caller's concern)."""
    if len(words) < size:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(words) - size + 1, U64)
        for j in range(size):
            out += words[j : j + len(out)] * _PLACE[j]
        return mix(out + U64(size))


def row_shingles(data: np.ndarray, off: np.ndarray, size: int, fold: bool = True) -> Iterator[np.ndarray]:
    """For each row its sorted distinct shingle hashes; a row of fewer words has its whole sequence as the one shingle."""
    starts, ends, first = word_bounds(data, off)
    words = word_hashes(data, starts, ends, fold)
    grams = shingle_hashes(words, size)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:
            yield shingle_hashes(words[a:b], int(b - a))
        else:
            yield np.zeros(0, U64)
