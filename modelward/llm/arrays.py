"""Words of Arrow text batches as numpy arrays: hashes and byte spans, in blocks of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegralType

BLOCK = 1 << 18
_LIBC = ctypes.CDLL(None)
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64

#: ``[\x20\x09-\x0D]``
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
#: A random 64-bit number for each byte, and the same with A-Z read as a-z.
EXACT, FOLDED = _BYTES, _BYTES[_FOLD]

_powers = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, BLOCK + 1), base, _U)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on all input bits."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = EXACT, prefixes: tuple[int, ...] = ()) -> np.ndarray:
    """A 64-bit hash of each byte span, from one running sum over the block.

    With ``prefixes``, a row per span: the hash of the whole, then those of its first so many bytes, 0 where it is no longer.
    """
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(table[data] * up[: len(data)], out=sums[1:])
    of = lambda ends: mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))
    if not prefixes:
        return of(ends)
    out = np.zeros((len(starts), 1 + len(prefixes)), _U)
    out[:, 0] = of(ends)
    for k, n in enumerate(prefixes):
        # The salt keeps a prefix apart from a word of the same letters.
        out[:, k + 1] = np.where(ends - starts > n, of(np.minimum(starts + n, ends)) ^ _U(_BASE), _U(0))
    return out


def whole_ids(docs: DataFrame, id_column: str) -> None:
    """Refuses ids that are not whole numbers, before any task runs."""
    if not isinstance(docs.select(id_column).schema[0].dataType, IntegralType):
        raise TypeError(f"{id_column} must hold whole numbers")


def give_back() -> None:
    """Hands memory that a task has freed back to the system, as its worker goes on to later tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the n + 1 offsets of its rows; null reads as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)), offsets


def row_blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``size`` bytes together; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield first, last
        first = last


def cuts(data: np.ndarray, breakable, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Cuts one long text into parts of about ``size`` bytes that begin only where ``breakable`` of a stretch says so."""
    first, n = 0, len(data)
    while first < n:
        last, step = n, size
        while first + step < n:
            found = np.flatnonzero(breakable(data[first : first + step + 1]))
            if len(found) and found[-1] > 0:
                last = first + int(found[-1])
                break
            step *= 2
        yield first, last
        first = last


def word_spans(data: np.ndarray, breaks: np.ndarray, gaps: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block; ``breaks`` are the offsets where a row begins, ``gaps`` the bytes between words."""
    solid = ~gaps[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    begins[inner] = solid[inner]
    finish = solid.copy()
    finish[:-1] &= ~solid[1:]
    finish[inner - 1] = solid[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(finish) + 1


def word_blocks(texts: pa.Array, table: np.ndarray = EXACT, gaps: np.ndarray = WHITE, prefixes: tuple[int, ...] = ()) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, number of words per row, word starts, word ends), by blocks of whole rows.

    Starts and ends count bytes from the beginning of the first row. A row longer than a block is hashed in parts cut
    before a gap and still comes as one block.
    """
    data, offsets = buffers(texts)
    for first, last in row_blocks(offsets):
        base, stop = int(offsets[first]), int(offsets[last])
        block = data[base:stop]
        if len(block) <= 2 * BLOCK:
            breaks = offsets[first : last + 1] - base
            starts, ends = word_spans(block, breaks, gaps)
            counts = np.diff(np.searchsorted(starts, breaks))
            yield first, last, span_hashes(block, starts, ends, table, prefixes), counts, starts, ends
        else:
            parts = []
            for a, b in cuts(block, gaps.__getitem__):
                s, e = word_spans(block[a:b], np.zeros(0, np.int64), gaps)
                parts.append((span_hashes(block[a:b], s, e, table, prefixes), s + a, e + a))
            h, s, e = (np.concatenate(x) for x in zip(*parts))
            yield first, last, h, np.array([len(h)]), s, e


def row_ends(counts: np.ndarray) -> np.ndarray:
    """Bounds of ragged rows from their lengths: n + 1 numbers."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of the elements of ragged rows, row after row."""
    lengths = np.asarray(lengths, np.int64)
    if not len(lengths) or not lengths.sum():
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)
