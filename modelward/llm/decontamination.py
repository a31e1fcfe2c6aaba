"""Benchmark passages in documents: latent semantic retrieval, then longest common subsequences and answers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from modelward.llm.arrays import FOLDED, give_back, mixed, ragged, row_blocks, row_ends, word_blocks
from modelward.llm.pretokens import Known

#: A passage is WINDOW words; documents are read every STEP words, benchmark items every QUERY_STEP.
WINDOW, STEP, QUERY_STEP = 12, 6, 3
#: Dimensions of the latent space, and those added while it is sought.
RANK, SPARE, POWER_ROUNDS = 48, 8, 2
#: The latent space is fitted on all documents. Together they weigh no more than so many, so that however large the corpus
#: is, what the benchmark's own passages add to the space is not lost beside it.
FIT_DOCUMENTS = 4000
#: Documents, at least, for each task that fits, whose result is as large as the vocabulary; words fitted at once.
TASK_DOCUMENTS, FIT_WORDS = 16000, 1 << 17
#: The cosine of a candidate.
COSINE = 0.7
#: Share of an item's words, in order, that make a hit; and the lower one that does when the item's answer is there too.
LCS_SHARE, LCS_WITH_ANSWER, ANSWER_WORDS = 0.6, 0.45, 4
#: Share of the words that a hit needs which must be among an item's rarer ones, for the index of words.
RARER = 0.5
#: Words and items of the benchmark that are searched at once; more take further passes over the documents.
BLOCK_WORDS, BLOCK_ITEMS = 200_000, 60_000
#: Pairs of passages and items whose cosines are taken at once.
PAIRS = 1 << 16


@dataclass
class Item:
    item_id: bytes  # names the item's text
    words: np.ndarray
    answer: np.ndarray  # the last sentence, if it has ANSWER_WORDS


@dataclass
class Index:
    """What the search needs of one block of the benchmark."""

    items: list[Item]
    vocabulary: np.ndarray  # sorted word hashes
    idf: np.ndarray
    basis: np.ndarray | None = None  # words x RANK
    frequency: np.ndarray | None = None

    def places(self) -> Known:
        known = Known(max(12, int(4 * len(self.vocabulary)).bit_length()))
        known.add(self.vocabulary, np.arange(len(self.vocabulary)))
        return known


def hashed(text: str) -> np.ndarray:
    return np.concatenate([h for _, _, h, _, _, _ in word_blocks(pa.array([text]), FOLDED)])


def items_of(rows: list) -> list[Item]:
    out = []
    for item_id, text in rows:
        words = hashed(text or "")
        if len(words):
            last = [s for s in re.split(r"(?<=[.!?:])\s+|\n+", text.strip()) if s.strip()][-1]
            answer = hashed(last)
            out.append(Item(item_id, words, answer if ANSWER_WORDS <= len(answer) < len(words) else answer[:0]))
    return out


def texts_only(docs: DataFrame, text_column: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text_column), F.lit("")).alias("text"))


def corpus_pass(docs: DataFrame, vocabulary: np.ndarray, text_column: str) -> tuple[np.ndarray, int, DataFrame]:
    """One pass over all documents: how many hold each word of the vocabulary, their number, and the texts to fit on.

    These are all texts that hold a word of the vocabulary, as places in it, with the number of their copies; texts are copies
    if they have the same words. They stay on disk until the caller gives them back.
    """
    documents, unknown = docs.count(), len(vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, kind = Index([], vocabulary, np.zeros(0)).places(), np.min_scalar_type(unknown)
        for batch in batches:
            for _, _, hashes, counts, _, _ in word_blocks(batch.column(0), FOLDED):
                at, bounds = places.find(hashes), row_ends(counts)
                some = np.diff(row_ends(at >= 0)[bounds]) > 0
                # unknown words are told apart here: texts that differ in them alone are no copies
                order = mixed(ragged(np.zeros(len(counts), np.int64), counts).astype(np.uint64))
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes + order))])
                mark = (sums[bounds[1:]] - sums[bounds[:-1]])[some].view(np.int64)
                words = np.where(at >= 0, at, unknown).astype(kind)[np.repeat(some, counts)]
                ends = row_ends(counts[some] * kind.itemsize).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(mark), pa.Array.from_buffers(pa.binary(), len(mark), [None, pa.py_buffer(ends), pa.py_buffer(words)])], ["mark", "words"])
        give_back()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(unknown, np.int64)
        for batch in batches:
            copies = batch.column(1).to_numpy()
            for first, words, counts in place_blocks(batch.column(0), unknown):
                known = np.flatnonzero(words < unknown)
                pairs = np.unique(np.repeat(np.arange(len(counts)), counts)[known] * unknown + words[known])
                total += np.bincount(pairs % unknown, copies[first + pairs // unknown], unknown).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["word", "n"])
        give_back()

    texts = texts_only(docs, text_column).mapInArrow(read, "mark bigint, words binary").groupBy("mark", "words").agg(F.count(F.lit(1)).alias("copies"))
    texts = texts.select("words", "copies").coalesce(max(8, documents // TASK_DOCUMENTS)).persist(StorageLevel.DISK_ONLY)
    # One row per word of the benchmark block: a bounded table.
    found = texts.mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(unknown, np.int64)
    out[found["word"].to_numpy()] = found["n"].to_numpy()
    return out, documents, texts


def place_blocks(texts: pa.Array, unknown: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, places, number of places per row) of texts kept as places, in blocks of whole rows of about FIT_WORDS."""
    kind, texts = np.min_scalar_type(unknown), texts.cast(pa.large_binary())
    if len(texts):
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] // kind.itemsize
        places = np.frombuffer(texts.buffers()[2], kind)
        for first, last in row_blocks(ends, FIT_WORDS):
            yield first, places[ends[first] : ends[last]], np.diff(ends[first : last + 1])


def window_starts(n: int, step: int) -> np.ndarray:
    """Where the passages of ``n`` words begin; the last one ends with the text."""
    return np.unique(np.append(np.arange(0, max(n - WINDOW, 0) + 1, step), max(n - WINDOW, 0)))


def runs_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end of the last."""
    return np.append(np.flatnonzero(np.append(True, values[1:] != values[:-1])), len(values))


def weighted_sums(table: np.ndarray, rows: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of weighted rows of a table, one for each of the groups that follow each other, of a few rows each."""
    starts, out = row_ends(sizes)[:-1], np.empty((len(sizes), table.shape[1]), np.float32)
    for n in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == n)
        at = starts[mine][:, None] + np.arange(n)
        out[mine] = np.einsum("gn,gnr->gr", weights[at], table[rows[at]])
    return out


def add_passages(total: np.ndarray, x: np.ndarray, idf: np.ndarray, words: np.ndarray, counts: np.ndarray) -> None:
    """Adds to ``total`` the part of ``A' A x`` that the passages of texts make; ``words`` are places, those beyond all are unknown."""
    passage = np.repeat(row_ends(-(-counts // WINDOW))[:-1], counts) + ragged(np.zeros(len(counts), np.int64), counts) // WINDOW
    known = np.flatnonzero(words < len(idf))
    words, bounds = words[known], runs_of(passage[known])
    for a, b in row_blocks(bounds, FIT_WORDS) if len(known) else ():
        mine, sizes = words[bounds[a] : bounds[b]], np.diff(bounds[a : b + 1])
        w, passage = idf[mine].astype(np.float32), np.repeat(np.arange(b - a), sizes)
        w /= np.sqrt(np.maximum(np.add.reduceat(w * w, bounds[a:b] - bounds[a]), 1e-12))[passage]
        seen = weighted_sums(x, mine, w, sizes)
        # The same the other way: of each word the passages that have it, a few at a time.
        order = np.argsort(mine, kind="stable")
        ends = runs_of(mine[order])
        parts = -(-np.diff(ends) // WINDOW)
        sizes = np.minimum(WINDOW, np.repeat(np.diff(ends), parts) - ragged(np.zeros(len(parts), np.int64), parts) * WINDOW)
        back = weighted_sums(seen, passage[order], w[order], sizes)
        total[mine[order[ends[:-1]]]] += np.add.reduceat(back, row_ends(parts)[:-1])


def fitted_basis(texts: DataFrame, index: Index, weight: float, seed: int = 3) -> np.ndarray:
    """The leading right singular vectors of the TF-IDF matrix of passages, by randomised subspace iteration.

    The matrix has a row per passage of all documents, copies of a text once, and of the block's items, so that every word of
    the items has a place in the space, whatever the documents hold; the squares of the documents' rows are taken ``weight``
    times. Tasks hold rows and return their part of ``A' A x``, a table of vocabulary x (RANK + SPARE) numbers, which Spark
    adds up; the driver adds the items and makes it orthogonal.
    """
    vocabulary, idf = index.vocabulary, index.idf
    width = min(RANK + SPARE, len(vocabulary))
    own = np.searchsorted(vocabulary, np.concatenate([item.words for item in index.items])), np.array([len(item.words) for item in index.items])

    def applied(x: np.ndarray) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(x.shape, np.float32)
            for batch in batches:
                for _, words, counts in place_blocks(batch.column(0), len(idf)):
                    add_passages(total, x, idf, words, counts)
            some = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(list(total[some]), pa.list_(pa.float32()))], ["word", "v"])
            give_back()

        sums = F.array(*[F.sum(F.get("v", F.lit(k))) for k in range(width)])
        found = texts.select("words").mapInArrow(part, "word bigint, v array<float>").groupBy("word").agg(sums.alias("v")).toArrow()
        out = np.zeros(x.shape)
        if len(found):
            out[found["word"].to_numpy()] = weight * np.array(found["v"].combine_chunks().flatten()).reshape(-1, width)
        add_passages(out, x, idf, *own)
        return out

    x = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(vocabulary), width)))[0].astype(np.float32)
    for _ in range(POWER_ROUNDS):
        x = np.linalg.qr(applied(x))[0].astype(np.float32)
    inner = x.T @ applied(x)
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    return (x @ turn[:, np.argsort(values)[::-1][:RANK]]).astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def common_subsequence(left: np.ndarray, right: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits of one whole number."""
    masks: dict[int, int] = {}
    for i, w in enumerate(left.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(left)) - 1
    rest = full
    for w in right.tolist():
        hit = rest & masks.get(w, 0)
        rest = (rest + hit | rest - hit) & full
    return len(left) - rest.bit_count()


def holds(words: np.ndarray, part: np.ndarray) -> bool:
    """Whether ``part`` occurs in ``words`` without gaps."""
    at = np.flatnonzero(words[: max(len(words) - len(part) + 1, 0)] == part[0])
    return any(np.array_equal(words[a : a + len(part)], part) for a in at)


class Searcher:
    def __init__(self, index: Index) -> None:
        self.index, self.known = index, index.places()
        rows, self.owner, self.offset = [], [], []
        for k, item in enumerate(index.items):
            at = np.searchsorted(index.vocabulary, item.words)
            for s in window_starts(len(item.words), QUERY_STEP).tolist():
                mine = at[s : s + WINDOW]
                rows.append((index.idf[mine][:, None] * index.basis[mine]).sum(axis=0))
                self.owner.append(k)
                self.offset.append(s)
        self.queries = unit(np.array(rows, np.float32))
        self.owner, self.offset = np.array(self.owner), np.array(self.offset)
        self.lengths = np.array([len(item.words) for item in index.items])
        self.flat, self.heads = np.searchsorted(index.vocabulary, np.concatenate([item.words for item in index.items])), row_ends(self.lengths)
        self.passages = np.bincount(self.owner, minlength=len(index.items))
        self.first_query = row_ends(self.passages)
        # Rows of marks, one for each candidate of a turn; the last mark of a row stands for all other words.
        self.turn = max(1, (1 << 22) // (len(index.vocabulary) + 1))
        self.present = np.zeros(self.turn * (len(index.vocabulary) + 1), bool)
        self.scaled = (index.idf[:, None] * index.basis).astype(np.float32)
        self.slack = STEP + self.lengths // 4
        self.needed = np.ceil(LCS_WITH_ANSWER * self.lengths).astype(np.int64)
        self.index_rarer()

    def index_rarer(self) -> None:
        """Lists, for each word of the vocabulary, the items that have it among their rarer words.

        A common subsequence of ``needed`` words has at most as many among an item's commonest words as there are; so with
        the ``lengths - needed + least`` rarest ones listed, at least ``least`` of its words are listed for the item.
        """
        self.least = np.maximum(1, np.ceil(RARER * self.needed)).astype(np.int64)
        frequency = self.index.frequency
        words, owners = [], []
        for k, n in enumerate((self.lengths - self.needed + self.least).tolist()):
            mine = self.flat[self.heads[k] : self.heads[k + 1]]
            listed = np.unique(mine[np.argsort(frequency[mine], kind="stable")[:n]])
            words.append(listed)
            owners.append(np.full(len(listed), k))
        words, owners = np.concatenate(words), np.concatenate(owners)
        order = np.argsort(words, kind="stable")
        self.listed = owners[order].astype(np.uint16)
        self.lists = row_ends(np.bincount(words, minlength=len(self.index.vocabulary)))

    def near(self, at: np.ndarray, bounds: np.ndarray, first_passage: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Pairs of an item and a passage around which ``least`` listed words of the item stand closely enough for a hit.

        Nothing else can be a hit, whatever the other words are. Pairs come as ``item * passages + passage``, in order.
        """
        known = np.flatnonzero(at >= 0)
        n = np.diff(self.lists)[at[known]]
        known, n = known[n > 0], n[n > 0]
        place, item = np.repeat(known, n), self.listed[ragged(self.lists[at[known]], n)]
        order = np.argsort(item, kind="stable")
        row = np.repeat(np.searchsorted(bounds, known, side="right") - 1, n)[order]
        place, item = place[order], item[order].astype(np.int64)
        last = np.arange(len(item)) + self.least[item] - 1
        first = np.flatnonzero(last < len(item))
        last = last[first]
        room = (self.lengths + 2 * self.slack)[item[first]]
        close = (item[last] == item[first]) & (row[last] == row[first]) & (place[last] - place[first] < room)
        first, last = first[close], last[close]
        mine, base = item[first], bounds[row[first]]
        # Where a passage of the item may begin, so that the words around it hold all of these.
        low = (place[last] - self.lengths[mine] - self.slack[mine] - base) // STEP
        high = (place[first] + self.slack[mine] + self.lengths[mine] - base) // STEP + 1
        top = many[row[first]] - 1
        low, high = np.clip(low, 0, top), np.clip(high, 0, top)
        total, found = int(many.sum()), []
        for part in np.array_split(np.arange(len(first)), len(first) // PAIRS + 1):
            sizes = high[part] - low[part] + 1
            found.append(np.unique(np.repeat(mine[part] * total + first_passage[row[first[part]]], sizes) + ragged(low[part], sizes)))
        return np.unique(np.concatenate(found))

    def shared(self, at: np.ndarray, owners: np.ndarray, firsts: np.ndarray, lasts: np.ndarray) -> np.ndarray:
        """Words of each candidate's item that occur between its bounds at all; a common subsequence has no more."""
        out, width = np.zeros(len(owners), np.int64), len(self.index.vocabulary) + 1
        work = row_ends(lasts - firsts + self.lengths[owners])
        a = 0
        while a < len(owners):
            b = min(a + self.turn, max(a + 1, int(np.searchsorted(work, work[a] + (1 << 18), side="right")) - 1))
            mine, sizes, base = owners[a:b], lasts[a:b] - firsts[a:b], np.arange(b - a) * width
            near = at[ragged(firsts[a:b], sizes)]
            here = np.repeat(base, sizes)[near >= 0] + near[near >= 0]
            self.present[here] = True
            wanted = np.repeat(base, self.lengths[mine]) + self.flat[ragged(self.heads[mine], self.lengths[mine])]
            out[a:b] = np.add.reduceat(self.present[wanted], row_ends(self.lengths[mine])[:-1], dtype=np.int64)
            self.present[here] = False
            a = b
        return out

    def hits(self, words: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, float, int, bool]]:
        """(row, item, cosine, common words, answer found) of the items that the rows of a block hold; one for each."""
        index, bounds = self.index, row_ends(counts)
        if not len(words):
            return
        at = self.known.find(words)
        inside = row_ends(at >= 0)
        # Passages of each row every STEP words; the last one ends with the row.
        room = np.maximum(counts - WINDOW, 0)
        many = np.where(counts > 0, -(-room // STEP) + 1, 0)
        row = np.repeat(np.arange(len(counts)), many)
        starts = bounds[row] + np.minimum(ragged(np.zeros(len(many), np.int64), many) * STEP, room[row])
        sizes = np.minimum(WINDOW, counts[row])
        pairs = self.near(at, bounds, row_ends(many)[:-1], many)
        # A passage without words of the benchmark has no vector.
        pairs = pairs[inside[(starts + sizes)[pairs % len(row)]] > inside[starts[pairs % len(row)]]] if len(pairs) else pairs
        best: dict[tuple[int, int], tuple] = {}
        tried: set[tuple[int, int, int]] = set()
        for part in np.array_split(pairs, len(pairs) // PAIRS + 1) if len(pairs) else []:
            passages, which = np.unique(part % len(row), return_inverse=True)
            flat = at[ragged(starts[passages], sizes[passages])]
            vectors = unit(np.add.reduceat(np.where((flat >= 0)[:, None], self.scaled[flat], 0), row_ends(sizes[passages])[:-1]))
            owners = part // len(row)
            times = self.passages[owners]
            cols, which = ragged(self.first_query[owners], times), np.repeat(which, times)
            cosines = np.einsum("ij,ij->i", vectors[which], self.queries[cols])
            # A passage amid other words is unlike an item that is shorter; those are looked at wherever their words are.
            seen = np.flatnonzero((cosines >= COSINE) | (self.lengths[self.owner[cols]] < WINDOW))
            values, which, cols = cosines[seen], passages[which[seen]], cols[seen]
            rows, begins, owners = row[which], starts[which] - self.offset[cols], self.owner[cols]
            # Of one place of a document and an item, the passage with the largest cosine; best ones first.
            order = np.argsort(-values, kind="stable")
            span = (len(words) + len(self.flat)) // STEP + 2
            places = (rows[order] * len(index.items) + owners[order]) * span + begins[order] // STEP + len(self.flat) // STEP + 1
            order = order[np.sort(np.unique(places, return_index=True)[1])]
            values, rows, begins, owners = values[order], rows[order], begins[order], owners[order]
            firsts, lasts = np.maximum(begins - self.slack[owners], bounds[rows]), np.minimum(begins + self.lengths[owners] + self.slack[owners], bounds[rows + 1])
            # Words of the benchmark between the bounds, then those of the item, bound the subsequence.
            needed = self.needed[owners]
            likely = np.flatnonzero(inside[lasts] - inside[firsts] >= needed)
            likely = likely[self.shared(at, owners[likely], firsts[likely], lasts[likely]) >= needed[likely]]
            found = zip(*(x[likely].tolist() for x in (rows, owners, begins, values, firsts, lasts)))
            for r, k, begin, cosine, first, last in found:
                if (r, k, begin // STEP) in tried or ((r, k) in best and best[r, k][1] == len(index.items[k].words)):
                    continue
                tried.add((r, k, begin // STEP))
                item, here = index.items[k], slice(first, last)
                region = words[here]
                common = common_subsequence(item.words, region)
                if common < LCS_WITH_ANSWER * len(item.words):
                    continue
                answer = bool(len(item.answer)) and holds(region, item.answer)
                if (common >= LCS_SHARE * len(item.words) or answer) and ((r, k) not in best or common > best[r, k][1]):
                    best[r, k] = (float(cosine), common, answer)
        for (r, k), (cosine, common, answer) in sorted(best.items()):
            yield r, k, cosine, common, answer


def blocks_of(texts: DataFrame) -> Iterator[list[Item]]:
    """The items of distinct texts in blocks of bounded size; the driver holds one of them, or a text that is longer."""
    held, size = [], 0
    for item in (i for r in texts.toLocalIterator() for i in items_of([(bytes(r[0]), r[1])])):
        held.append(item)
        size += len(item.words)
        if size >= BLOCK_WORDS or len(held) >= BLOCK_ITEMS:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item that it holds: ``doc_id, item_id, cosine, lcs_words, item_words, answer_found``.

    Every passage of every document is compared in a latent space with the passages of every item that it can be a hit of:
    an index of the items' rarer words finds, by counting alone, the places where enough of an item's words stand closely
    enough, and no other place can have the common subsequence. The words around a candidate then need one of LCS_SHARE of
    the item's words, or of LCS_WITH_ANSWER if the item's last sentence is there word by word. Items shorter than a passage
    need no cosine. Words are split at white space, with A-Z lower-cased.

    The items are a stated set of queries: their distinct texts are taken to the tasks in blocks of BLOCK_WORDS words, each
    with a pass over the documents, and meet the items' ids again in a join. Ids may have any type. Null and empty texts and
    items hold nothing; null ids and repeated rows are kept, one row each; items repeated in the benchmark are each reported;
    texts may be of any length; other columns are not read; empty tables give no rows.
    """
    spark, kind = docs.sparkSession, docs.schema[id_column].dataType.simpleString()
    text = F.col(item_text)
    # 128 bits and the length of its text name an item
    keyed = benchmark.where(text.isNotNull()).select(F.concat(F.unhex(F.md5(text.cast("binary"))), F.encode(F.octet_length(text).cast("string"), "utf-8")).alias("key"), F.col(item_column).alias("item_id"), text.alias("text"))
    out = f"doc_id {kind}, key binary, cosine double, lcs_words bigint, item_words bigint, answer_found boolean"
    found = spark.createDataFrame([], out)
    for block in blocks_of(keyed.groupBy("key").agg(F.min("text").alias("text"))):
        found = found.unionByName(searched(docs, block, out, id_column, text_column))
    return found.join(keyed.select("key", "item_id"), "key").select("doc_id", "item_id", "cosine", "lcs_words", "item_words", "answer_found")


def searched(docs: DataFrame, items: list[Item], out: str, id_column: str, text_column: str) -> DataFrame:
    """Hits of one block of items, by the keys of their texts."""
    vocabulary = np.unique(np.concatenate([i.words for i in items]))
    frequency, n, texts = corpus_pass(docs, vocabulary, text_column)
    idf = np.log((n + 1) / (frequency + 0.5)).clip(0.05)
    index = Index(items, vocabulary, idf, frequency=frequency)
    index.basis = fitted_basis(texts, index, min(1.0, FIT_DOCUMENTS / max(n, 1)))
    texts.unpersist()
    shared = docs.sparkSession.sparkContext.broadcast((index.items, index.vocabulary, index.idf, index.basis, index.frequency))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(Index(*shared.value))
        for batch in batches:
            ids, found = batch.column(0), []
            for first, _, hashes, counts, _, _ in word_blocks(batch.column(1), FOLDED):
                found += [(first + r, *hit) for r, *hit in searcher.hits(hashes, counts)]
            columns = list(zip(*found)) if found else [[]] * 5
            mine = [searcher.index.items[k] for k in columns[1]]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(columns[0], pa.int64())), pa.array([m.item_id for m in mine], pa.binary()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int64()), pa.array([len(m.words) for m in mine], pa.int64()), pa.array(columns[4], pa.bool_())],
                ["doc_id", "key", "cosine", "lcs_words", "item_words", "answer_found"],
            )
        give_back()

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(search, out)
