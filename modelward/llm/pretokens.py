"""Pre-tokens of byte-level BPE texts as byte spans, and a table of those already met."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from modelward.llm.arrays import BLOCK, buffers, cuts, row_blocks, row_ends, span_hashes

#: The special string of the vocabulary and the endings that split off after an apostrophe.
SPECIAL = "<|endoftext|>"
SHORT, LONG = b"stmd", (b"re", b"ve", b"ll")
OTHER, LETTER, NUMBER, WHITE = range(4)


@cache
def classes() -> np.ndarray:
    """Letter, number, white space or other, of every code point."""
    import regex

    points = [chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000)]
    text, out = "".join(points), np.zeros(0x110000, np.uint8)
    # The splitter takes the separators U+001C to U+001F for no white space.
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, text):
            out[m.start() : m.end()] = kind
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the place where each begins."""
    places = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[places].astype(np.int32)
    wide = np.flatnonzero(points >= 0xC0)
    if len(wide):
        at, lead = places[wide], points[wide]
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        tail = [padded[at + k].astype(np.int32) & 0x3F for k in (1, 2, 3)]
        two, three, four = (lead & 0x1F) << 6 | tail[0], (lead & 0x0F) << 12 | tail[0] << 6 | tail[1], (lead & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]
        points[wide] = np.minimum(np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four)), 0x10FFFF)
    return points, places


def pretoken_starts(data: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in a block of texts; ``breaks`` are the offsets of the texts."""
    points, places = code_points(data)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(places, breaks)] = True
    edge[[0, n]] = True
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= edge[:-1]
    # The last white space before other text stands alone; a plain space joins what follows.
    white = kind == WHITE
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~edge[1:-1]) if n > 1 else np.zeros(0, np.int64)
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    # A contraction: an apostrophe that begins a pre-token, with its ending.
    for at in np.flatnonzero((points == 0x27) & start):
        tail = points[at + 1 : at + 3]
        inner = 2 - int(edge[at + 1]) * 2 - (int(edge[at + 2]) if at + 2 <= n and not edge[at + 1] else 0)
        tail = tail[: max(inner, 0)]
        if len(tail) and tail[0] < 128 and tail[0] in SHORT:
            size = 2
        elif len(tail) == 2 and max(tail) < 128 and bytes(tail.tolist()) in LONG:
            size = 3
        else:
            continue
        start[at + 1 : at + size] = False
        if at + size < n:
            after = at + size
            # A plain space before other text has been joined to it already; everything else begins anew.
            start[after] = True
    return places[start]


def _between_words(data: np.ndarray) -> np.ndarray:
    """A space between two ASCII letters: a text may be cut before it."""
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    found = np.zeros(len(data), bool)
    found[1:-1] = (data[1:-1] == 32) & letter[:-2] & letter[2:]
    return found


def pretoken_blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, pre-token starts, ends, hashes) of blocks; a long row comes as several blocks."""
    data, offsets = buffers(texts)
    for first, last in row_blocks(offsets):
        base, stop = int(offsets[first]), int(offsets[last])
        parts = [(base, stop)] if stop - base <= 2 * BLOCK else [(base + a, base + b) for a, b in cuts(data[base:stop], _between_words)]
        for a, b in parts:
            block = data[a:b]
            breaks = offsets[first : last + 1] - base if len(parts) == 1 else np.zeros(1, np.int64)
            starts = pretoken_starts(block, breaks)
            ends = np.append(starts[1:], len(block)) if len(starts) else starts
            yield first, last, block, starts, ends, span_hashes(block, starts, ends)


def without_specials(texts: pa.Array) -> tuple[pa.Array, np.ndarray | None]:
    """The texts cut at the special string, and the row of each piece; None where no text holds it."""
    texts = pc.fill_null(texts, "")
    has = pc.match_substring(texts, SPECIAL)
    if not pc.any(has).as_py():
        return texts, None
    pieces, rows = [], []
    for i, text in enumerate(texts.to_pylist()):
        cut = text.split(SPECIAL)
        pieces += cut
        rows += [i] * len(cut)
    return pa.array(pieces, pa.large_string()), np.array(rows, np.int64)


class Known:
    """A hash table in arrays, from 64-bit keys to rows of ``values``; emptied when half full."""

    def __init__(self, bits: int = 21) -> None:
        self.bits, self.mask = bits, (1 << bits) - 1
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.rows = np.zeros(1 << self.bits, np.int64)
        self.size = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left, at = np.arange(len(keys)), (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            there = self.keys[at]
            same = there == keys[left]
            out[left[same]] = self.rows[at[same]]
            on = ~same & (there != 0)
            left, at = left[on], (at[on] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """New, distinct, nonzero keys."""
        left, at = np.arange(len(keys)), (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[left[free]]
            self.rows[at[free]] = rows[left[free]]
            on = self.keys[at] != keys[left]  # taken, or lost to another new key
            left, at = left[on], (at[on] + 1) & self.mask
        self.size += len(keys)

    def room_for(self, n: int) -> bool:
        return self.size + n <= self.mask // 2


def first_of_each(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the place of one of each."""
    distinct, place = np.unique(keys, return_index=True)
    return distinct, place


__all__ = ["Known", "classes", "first_of_each", "pretoken_blocks", "pretoken_starts", "row_ends", "without_specials"]
