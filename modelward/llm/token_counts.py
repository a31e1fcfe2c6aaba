"""Token counts of texts by byte-pair merging of whole batches of pre-tokens at once."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelward.llm.arrays import mixed, ragged, row_ends
from modelward.llm.pretokens import Known, first_of_each, pretoken_blocks, without_specials

NONE = np.iinfo(np.int64).max


def byte_symbols() -> dict[str, int]:
    """The printable character that the vocabulary file writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Ranked merges of a vocabulary, applied to many sequences in step."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.first = np.zeros(256, np.int64)
        for c, b in byte_symbols().items():
            self.first[b] = vocab[c]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.ranks = Known(18)
        self.ranks.add(self.key(np.array([vocab[a] for a, _ in pairs]), np.array([vocab[b] for _, b in pairs])), np.arange(len(pairs)))

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return mixed((left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)) + np.uint64(1))

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Symbols left of each byte span.

        All spans lie in one flat array of symbols. In a round every span finds its lowest-ranked pair and merges all
        places of it, from the left where they overlap; spans without a pair leave the array.
        """
        out = (ends - starts).astype(np.int64)
        who = np.flatnonzero(out > 1)
        symbols = self.first[data[ragged(starts[who], out[who])]]
        sizes = out[who]
        while len(who):
            bounds = row_ends(sizes)
            ranks = np.full(len(symbols), NONE)
            if len(symbols) > 1:
                inner = np.ones(len(symbols), bool)
                inner[bounds[1:] - 1] = False
                at = np.flatnonzero(inner)
                found = self.ranks.find(self.key(symbols[at], symbols[at + 1]))
                ranks[at] = np.where(found < 0, NONE, found)
            best = np.minimum.reduceat(ranks, bounds[:-1])
            open_ = best != NONE
            out[who[~open_]] = sizes[~open_]
            merge = (ranks == np.repeat(best, sizes)) & (ranks != NONE)
            places = np.flatnonzero(merge)
            # Overlapping places come in runs; every second one of a run merges.
            fresh = np.ones(len(places), bool)
            fresh[1:] = np.diff(places) != 1
            order = np.arange(len(places))
            places = places[(order - np.maximum.accumulate(np.where(fresh, order, 0))) % 2 == 0]
            symbols[places] = self.made[ranks[places]]
            stay = np.repeat(open_, sizes)
            stay[places + 1] = False
            gone = np.diff(np.searchsorted(places, bounds))
            symbols, sizes, who = symbols[stay], (sizes - gone)[open_], who[open_]
        return out


class Counter:
    """Counts tokens per text; counts of pre-tokens met before are kept in a table of bounded size."""

    def __init__(self, path: str) -> None:
        self.merges, self.known = Merges(path), Known()

    def __call__(self, texts: pa.Array) -> np.ndarray:
        whole = len(texts)
        texts, rows = without_specials(texts)
        totals = np.zeros(len(texts), np.int64)
        for first, last, block, starts, ends, hashes in pretoken_blocks(texts):
            counts = self.known.find(hashes)
            new = np.flatnonzero(counts < 0)
            if len(new):
                keys, place = first_of_each(hashes[new])
                made = self.merges.counts(block, starts[new[place]], ends[new[place]])
                counts[new] = made[np.searchsorted(keys, hashes[new])]
                if not self.known.room_for(len(keys)):
                    self.known.clear()
                if self.known.room_for(len(keys)):
                    self.known.add(keys, made)
            if last - first == 1:
                totals[first] += counts.sum()
            else:
                sums = row_ends(counts)
                lengths = offsets_of(texts, first, last)
                totals[first:last] += np.diff(sums[np.searchsorted(starts, lengths)])
        if rows is None:
            return totals
        # Each cut was one special token.
        return np.bincount(rows, totals, whole).astype(np.int64) + np.bincount(rows, minlength=whole) - 1


def offsets_of(texts: pa.Array, first: int, last: int) -> np.ndarray:
    """Byte offsets of rows, from the first one's beginning."""
    return row_ends(pc.binary_length(texts.slice(first, last - first)).to_numpy(zero_copy_only=False))


@cache
def counter(path: str) -> Counter:
    """One per worker process, so that its table serves many tasks."""
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 1024) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``vocabulary`` is a byte-level BPE file that every executor can read. The special string inside a text is one token,
    as in the library. Null counts as empty, with no bytes and no tokens; null ids and repeated rows are kept; other
    columns are not read; an empty table gives no rows. A long text is worked on in parts cut between words.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(vocabulary)
        for batch in batches:
            texts = batch.column(1)
            size = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
            n = tokens(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
