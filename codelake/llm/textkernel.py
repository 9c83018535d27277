"""Vectorized helpers over the UTF-8 buffer of an Arrow string column; no loop runs per word."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 2 << 20  # bytes of text looked at together, so that the 8-byte arrays beside it stay small

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 2**63, dtype=np.uint64)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes; a longer row is alone in its range."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1, lo + 1)
        yield lo, hi
        lo = hi


def parts(batches: Iterator[pa.RecordBatch], limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about `limit` bytes of column `text`, so that what is made of one stays small."""
    for batch in batches:
        for lo, hi in blocks(utf8(batch.column("text"))[1], limit):
            yield batch.slice(lo, hi - lo)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _raised(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, 1 << 16)
        known = np.full(size, base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if size <= BLOCK + 1:
            _powers[base] = known
    return known[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end): equal spans, equal hashes, wherever they stand."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _raised(_BASE, len(data)), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _raised(_INVERSE, len(data) + 1)[starts]
    return mixed(raw ^ (ends - starts).astype(np.uint64))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def lower_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes (A-Z only), word starts, word ends, and for each row the index of its first word."""
    low = _LOWER[data]
    word = ~_BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[1:-1] = word[:-1]  # goes on from the byte before
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edge] = False
    starts = np.flatnonzero(word & ~first[:-1])
    last = np.ones(len(data), bool)
    last[:-1] = ~word[1:]
    last[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    ends = np.flatnonzero(word & last) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices begin, begin + 1, ... of each range, one range after the other."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = begin - (np.cumsum(size) - size)
    return np.repeat(shift, size) + np.arange(total)
