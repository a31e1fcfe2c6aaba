"""Token ids in binary files of directly addressable codes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modelward.llm.arrays import give_back, ragged, row_ends, whole_ids
from modelward.llm.pretokens import Known, first_of_each, pretoken_blocks, without_specials
from modelward.llm.token_counts import offsets_of

MAGIC = b"DACIDS1\n"
HEAD = struct.Struct("<8sqqqqB7x")  # magic, partition, sequence, documents, tokens, levels
LEVEL = struct.Struct("<qB7x")  # elements, bits each
#: Bits between entries of a rank directory.
RANK_STEP = 512
#: Chunk widths that a file may use, level by level; each file takes the ones that make it smallest.
LAYOUTS = ((8, 8, 8, 8), (12, 4, 8, 8), (12, 8, 12), (8, 4, 4, 16), (16, 16))
NO_ID = -(1 << 63)


def packed(values: np.ndarray, width: int) -> np.ndarray:
    """Values of ``width`` bits, a multiple of 4, as nibbles, two a byte, low ones first."""
    k = width // 4
    nibbles = np.zeros(len(values) * k + (len(values) * k) % 2, np.uint8)
    for j in range(k):
        nibbles[j : len(values) * k : k] = (values >> (4 * j)) & 15
    return nibbles[::2] | nibbles[1::2] << 4


class DirectCodes:
    """Numbers split into chunks: level 0 has the lowest chunk of every number, and each next level that of the numbers
    whose continuation bit is set. The place of a number on the next level is the rank of its bit, which a directory of
    running counts and the bits of one stretch give; nothing else is decoded.
    """

    def __init__(self, levels: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.levels = levels  # elements, width, packed chunks, packed bits, directory

    @staticmethod
    def built(values: np.ndarray) -> DirectCodes:
        sizes = []
        for layout in LAYOUTS:
            shift, total = 0, 0
            for width in layout:
                n = int(np.count_nonzero(values >> shift)) if shift else len(values)
                total += n * (width + 1)
                shift += width
            sizes.append(total)
        levels, rest = [], values.astype(np.int64)
        for width in LAYOUTS[int(np.argmin(sizes))]:
            more = rest >> width
            bits = more > 0
            chunks = packed(rest & ((1 << width) - 1), width)
            sums = np.add.reduceat(bits, np.arange(0, len(bits), RANK_STEP)) if len(bits) else np.zeros(0, np.int64)
            levels.append((len(rest), width, chunks, np.packbits(bits, bitorder="little"), row_ends(sums).astype("<u8")))
            rest = more[bits]
            if not len(rest):
                break
        return DirectCodes(levels)

    def to_bytes(self) -> bytes:
        return b"".join(LEVEL.pack(n, width) + chunks.tobytes() + bits.tobytes() + ranks.tobytes() for n, width, chunks, bits, ranks in self.levels)

    @staticmethod
    def from_bytes(raw: memoryview, n_levels: int) -> DirectCodes:
        """Views of a file's bytes; nothing is unpacked."""
        levels, at = [], 0
        for _ in range(n_levels):
            n, width = LEVEL.unpack_from(raw, at)
            at += LEVEL.size
            parts = []
            for size, kind in (((n * (width // 4) + 1) // 2, np.uint8), ((n + 7) // 8, np.uint8), (8 * ((n + RANK_STEP - 1) // RANK_STEP + 1), np.dtype("<u8"))):
                parts.append(np.frombuffer(raw[at : at + size], kind))
                at += size
            levels.append((n, width, *parts))
        return DirectCodes(levels)

    def __len__(self) -> int:
        return self.levels[0][0] if self.levels else 0

    @staticmethod
    def _chunk(chunks: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for j in range(width // 4):
            nibble = at * (width // 4) + j
            out |= (chunks[nibble >> 1].astype(np.int64) >> ((nibble & 1) * 4) & 15) << (4 * j)
        return out

    def at(self, places) -> np.ndarray:
        """The numbers at any places, each found by itself."""
        places = np.asarray(places, np.int64)
        out, left, shift = np.zeros(len(places), np.int64), np.arange(len(places)), 0
        for _, width, chunks, bits, ranks in self.levels:
            out[left] |= self._chunk(chunks, width, places) << shift
            on = (bits[places >> 3] >> (places & 7) & 1).astype(bool)
            left, places, shift = left[on], places[on], shift + width
            if not len(left):
                break
            first = places // RANK_STEP
            step = RANK_STEP // 8
            bytes_ = np.minimum((first * step)[:, None] + np.arange(step), len(bits) - 1)  # past the end is never counted
            stretch = np.unpackbits(bits[bytes_], axis=1, bitorder="little")
            before = np.arange(RANK_STEP) < (places % RANK_STEP)[:, None]
            places = ranks[first].astype(np.int64) + (stretch.astype(bool) & before).sum(axis=1, dtype=np.int64)
        return out

    def all(self) -> np.ndarray:
        """Every number, level by level."""
        out, shift = np.zeros(len(self), np.int64), 0
        where = None
        for n, width, chunks, bits, _ in self.levels:
            k = width // 4
            nibbles = np.empty(len(chunks) * 2, np.uint8)
            nibbles[::2], nibbles[1::2] = chunks & 15, chunks >> 4
            values = np.zeros(n, np.int64)
            for j in range(k):
                values |= nibbles[j : n * k : k].astype(np.int64) << (4 * j)
            if where is None:
                out |= values
                where = np.flatnonzero(np.unpackbits(bits, count=n, bitorder="little"))
            else:
                out[where] |= values << shift
                where = where[np.flatnonzero(np.unpackbits(bits, count=n, bitorder="little"))]
            shift += width
        return out


def file_bytes(partition: int, sequence: int, ids: np.ndarray, lengths: np.ndarray, tokens: np.ndarray) -> bytes:
    """A file: a head, the documents' ids and lengths, and the codes of all their tokens."""
    codes = DirectCodes.built(tokens)
    return HEAD.pack(MAGIC, partition, sequence, len(ids), len(tokens), len(codes.levels)) + ids.astype("<i8").tobytes() + lengths.astype("<i8").tobytes() + codes.to_bytes()


def parsed(raw) -> tuple[int, int, np.ndarray, np.ndarray, DirectCodes]:
    """Partition, sequence, document ids, lengths and codes of a file's bytes."""
    raw = memoryview(raw)
    magic, partition, sequence, n, _, levels = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a file of token ids")
    at = HEAD.size
    ids, lengths = np.frombuffer(raw[at : at + 8 * n], "<i8"), np.frombuffer(raw[at + 8 * n : at + 16 * n], "<i8")
    return partition, sequence, ids, lengths, DirectCodes.from_bytes(raw[at + 16 * n :], levels)


class Encoder:
    """Ids of texts by the tokenizers library, called once per pre-token not met before."""

    def __init__(self, path: str, end: int) -> None:
        from tokenizers import Tokenizer

        self.library, self.end, self.known = Tokenizer.from_file(path), end, Known()
        self.forget()

    def forget(self) -> None:
        self.known.clear()
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool, self.rows, self.used = np.zeros(1 << 18, np.uint32), 0, 0

    def learn(self, keys: np.ndarray, texts: list[str]) -> None:
        if not self.known.room_for(len(keys)):
            self.forget()
        if not self.known.room_for(len(keys)):
            self.known = Known(max(self.known.bits, int(2 * len(keys)).bit_length() + 1))
        made = self.library.encode(texts, is_pretokenized=True, add_special_tokens=False)
        flat, lengths = np.array(made.ids, np.uint32), np.bincount(np.array(made.word_ids, np.int64), minlength=len(texts))
        rows, used = self.rows + len(keys), self.used + len(flat)
        if rows > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros(max(len(x), rows - len(x)), np.int64)]) for x in (self.starts, self.lengths))
        if used > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), used - len(self.pool)), np.uint32)])
        self.pool[self.used : used] = flat
        self.lengths[self.rows : rows] = lengths
        self.starts[self.rows : rows] = self.used + row_ends(lengths)[:-1]
        self.known.add(keys, np.arange(self.rows, rows))
        self.rows, self.used = rows, used

    def pieces(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, ids per row) of blocks of rows; a long row comes in several blocks."""
        for first, last, block, starts, ends, hashes in pretoken_blocks(texts):
            rows = self.known.find(hashes)
            new = np.flatnonzero(rows < 0)
            if len(new):
                keys, place = first_of_each(hashes[new])
                if not self.known.room_for(len(keys)):
                    self.forget()
                    keys, place = first_of_each(hashes)
                    new = np.arange(len(hashes))
                s, e, raw = starts[new[place]].tolist(), ends[new[place]].tolist(), block.tobytes()
                self.learn(keys, [raw[a:b].decode("utf-8", "replace") for a, b in zip(s, e)])
                rows = self.known.find(hashes)
            lengths = self.lengths[rows]
            ids = self.pool[ragged(self.starts[rows], lengths)]
            sums = row_ends(lengths)
            counts = np.array([len(ids)]) if last - first == 1 else np.diff(sums[np.searchsorted(starts, offsets_of(texts, first, last))])
            yield first, ids, counts

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, with the end id."""
        whole = len(texts)
        texts, rows = without_specials(texts)
        rows = np.arange(whole) if rows is None else rows
        special = self.library.token_to_id("<|endoftext|>")
        at, parts = 0, []
        seen = -1  # the piece that was met last
        for first, ids, counts in self.pieces(texts):
            for k, (a, b) in enumerate(zip(row_ends(counts)[:-1].tolist(), row_ends(counts)[1:].tolist())):
                piece = first + k
                while at < rows[piece]:
                    yield np.concatenate([*parts, np.array([self.end], np.uint32)])
                    parts, at = [], at + 1
                if piece != seen and parts:
                    parts.append(np.array([special], np.uint32))  # a later piece of one text
                if not parts:
                    parts.append(np.zeros(0, np.uint32))
                parts.append(ids[a:b])
                seen = piece
        while at < whole:
            yield np.concatenate([*parts, np.array([self.end], np.uint32)])
            parts, at = [], at + 1


@cache
def encoder(path: str, end: int) -> Encoder:
    """One per worker process, so that its table serves many tasks."""
    return Encoder(path, end)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end: int = 2, id_column: str = "doc_id", text_column: str = "text", file_tokens: int = 4_000_000) -> None:
    """Encodes every text, adds ``end``, and writes the ids in ascending order of document ids.

    Documents are dealt out by ranges of ids, and of a hash of the text where ids repeat, so no text is sampled for the
    ranges; each task sorts its range, encodes it and hands a file to Spark's writer as
    soon as it holds ``file_tokens`` ids, so memory is bounded by that and by one text. A file's head has its place in the
    order. The folder must be one that all executors and later readers share. A lost task is run again and its files are
    committed once. Ids must be whole numbers. Ties of ids are ordered by a hash of the text, then by the text; null ids come first; null texts hold only the end id.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, place = encoder(vocabulary, end), TaskContext.get().partitionId()
        ids, tokens, held, sequence = [], [], 0, 0

        def file() -> pa.RecordBatch:
            raw = file_bytes(place, sequence, np.array(ids, np.int64), np.array([len(t) for t in tokens], np.int64), np.concatenate(tokens))
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["file"])

        for batch in batches:
            keys = [NO_ID if i is None else i for i in batch.column(0).to_pylist()]
            for key, t in zip(keys, to_ids(batch.column(1))):
                ids.append(key)
                tokens.append(t)
                held += len(t)
                if held >= file_tokens:
                    yield file()
                    ids, tokens, held, sequence = [], [], 0, sequence + 1
        if ids:
            yield file()
        give_back()

    whole_ids(docs, id_column)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), F.xxhash64(F.col(text_column)).alias("mark"))
    ordered = rows.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text").select("doc_id", "text")
    files = ordered.mapInArrow(encode, "file binary")
    # One row is one file: its bytes, and the line end that the writer adds.
    files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files: ``part, sequence, place, doc_id, begin, n_tokens, ids_crc32``.

    ``part, sequence, place`` order the documents; ``begin`` counts the ids before a document in its file.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                part, sequence, ids, lengths, codes = parsed(raw.as_buffer())
                tokens, bounds = codes.all().astype("<u4"), row_ends(lengths)
                crcs = [zlib.crc32(tokens[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                n = len(ids)
                columns = [np.full(n, part), np.full(n, sequence), np.arange(n), ids, bounds[:-1], lengths, np.array(crcs, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "sequence", "place", "doc_id", "begin", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("content")
    rows = files.mapInArrow(decode, "part bigint, sequence bigint, place bigint, doc_id bigint, begin bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def token_starts(rows: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``: ``start`` counts the ids of all documents before.

    Files are summed per task that wrote them and then over tasks; only these sums meet in one place, one row per writing
    task. ``rows`` should be kept, as it is read three times.
    """
    files = rows.groupBy("part", "sequence").agg(F.sum("n_tokens").alias("tokens"))
    parts = files.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before(Window.partitionBy(F.lit(1)).orderBy("part")).alias("part_start"))
    files = files.select("part", "sequence", before(Window.partitionBy("part").orderBy("sequence")).alias("file_start"))
    places = files.join(parts, "part").select("part", "sequence", (F.col("part_start") + F.col("file_start")).alias("base"))
    return rows.join(places, ["part", "sequence"]).select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")
