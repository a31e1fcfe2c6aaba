"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelward.llm.arrays import FOLDED, buffers, give_back, row_ends, word_blocks
from modelward.llm.labels import held_out, labelled_rows, trained_in_task

#: A word is read whole and by its first so many bytes, so that a stem counts with any ending.
PREFIXES = (4, 5, 6, 7, 8)
#: A sentence ends at these, and after so many words at the latest.
STOPS = np.zeros(256, bool)
STOPS[list(b".!?\n")] = True
LONGEST = 32
#: Words are parted by all ASCII but letters and digits.
GAPS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
#: Bounds of the training sample, and of its documents in which a feature must occur.
TRAIN_ROWS, TRAIN_BYTES, LEAST_DOCUMENTS = 6000, 1 << 14, 4
#: Times the rate in clean documents that a feature's rate in toxic ones must be.
LEANING = 2.0
_SIEVE = 20


@dataclass
class Model:
    """``keys`` are the sorted hashes of the words and stems that have a weight."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float = -5.0
    #: Given to all documents when there is nothing to learn from.
    constant: float | None = None

    def __post_init__(self) -> None:
        self.sieve = np.zeros(1 << _SIEVE, bool)
        self.sieve[(self.keys >> np.uint64(64 - _SIEVE)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that have a weighted feature, and the feature's place."""
        words, column = np.nonzero(self.sieve[(hashes >> np.uint64(64 - _SIEVE)).astype(np.int64)])
        found = hashes[words, column]
        place = np.minimum(np.searchsorted(self.keys, found), max(len(self.keys) - 1, 0))
        right = self.keys[place] == found if len(self.keys) else np.zeros(len(found), bool)
        return words[right], place[right]


def instances(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, features of each word, first word of each sentence, sentences per row, word starts, word ends)."""
    data, offsets = buffers(texts)
    for first, last, hashes, counts, starts, ends in word_blocks(texts, FOLDED, GAPS, PREFIXES):
        base = int(offsets[first])
        bounds = row_ends(counts)
        stops = np.flatnonzero(STOPS[data[base : int(offsets[last])]])
        n = len(starts)
        opens = np.zeros(n, bool)
        opens[bounds[:-1][counts > 0]] = True
        after = np.searchsorted(stops, starts)
        opens[1:] |= after[1:] != after[:-1]
        heads = np.flatnonzero(opens)
        # Long ones are cut.
        place = np.arange(n) - np.repeat(heads, np.diff(np.append(heads, n)))
        heads = np.flatnonzero(place % LONGEST == 0)
        yield first, last, hashes, heads, np.diff(np.searchsorted(heads, bounds)), starts, ends


def sentence_logits(model: Model, hashes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Bias and the weights of a sentence's words; a word counts with its strongest feature."""
    words, place = model.hits(hashes)
    best = np.zeros(len(hashes), np.float32)
    np.maximum.at(best, words, model.weights[place])
    sums = np.add.reduceat(best, heads) if len(heads) else np.zeros(0)
    return np.clip(sums + model.bias, -30, 30)


def clean_odds(logits: np.ndarray, sentences: np.ndarray) -> np.ndarray:
    """log of the chance that no sentence of a document is toxic: noisy-or's complement."""
    sums = np.concatenate([[0.0], np.cumsum(-np.logaddexp(0, logits))])
    bounds = row_ends(sentences)
    return sums[bounds[1:]] - sums[bounds[:-1]]


def leaning(texts: pa.Array, labels: np.ndarray) -> np.ndarray:
    """Features that at least LEAST_DOCUMENTS documents hold and that lean to toxic ones, as sorted hashes.

    A feature leans by its rate in toxic documents over that in the others, whatever the share of toxic ones is.
    """
    many, few = labels.sum(), len(labels) - labels.sum()

    def chosen(n: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        # half a document more on both sides, so that rates of few documents don't run away
        return (n >= LEAST_DOCUMENTS) & ((toxic + 0.5) / (many + 1) >= LEANING * (n - toxic + 0.5) / (few + 1)) & (toxic >= 3)

    def held() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for first, last, hashes, heads, sentences, _, _ in instances(texts):
            row = np.repeat(np.repeat(np.arange(first, last), sentences), np.diff(np.append(heads, len(hashes))))
            yield row, hashes

    # First by buckets, to leave most features out; then by the hashes themselves.
    bits = 22
    n, toxic = np.zeros(1 << bits, np.float32), np.zeros(1 << bits, np.float32)
    for row, hashes in held():
        pairs = np.unique(row[:, None] << bits | (hashes >> np.uint64(64 - bits)).astype(np.int64))
        bucket, y = pairs & ((1 << bits) - 1), labels[pairs >> bits]
        n += np.bincount(bucket, minlength=1 << bits)
        toxic += np.bincount(bucket, y, 1 << bits)
    pick = chosen(n, toxic)
    keys, rows = [], []
    for row, hashes in held():
        words, column = np.nonzero(pick[(hashes >> np.uint64(64 - bits)).astype(np.int64)] & (hashes != 0))
        keys.append(hashes[words, column])
        rows.append(row[words])
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    if not len(distinct):
        return distinct
    pairs = np.unique(place.astype(np.int64) * len(labels) + np.concatenate(rows))
    count = np.bincount(pairs // len(labels), minlength=len(distinct))
    return distinct[chosen(count, np.bincount(pairs // len(labels), labels[pairs % len(labels)], len(distinct)))]


def fitted(texts: pa.Array, labels: np.ndarray, rounds: int = 500, rate: float = 0.05, sparsity: float = 2e-5) -> Model:
    """Descent on the likelihood of document labels under noisy-or, with weights held sparse and not below 0."""
    n = len(labels)
    if n == 0 or labels.min() == labels.max():
        return Model(np.zeros(0, np.uint64), np.zeros(0, np.float32), 0.0, (float(labels.sum()) + 1) / (n + 2))
    keys = leaning(texts, labels)
    model = Model(keys, np.zeros(len(keys), np.float32))
    sentences, words, places, first_word, total = np.zeros(n, np.int64), [], [], [], 0
    for first, last, hashes, heads, counts, _, _ in instances(texts):
        sentences[first:last] = counts
        w, place = model.hits(hashes)
        words.append(w + total)
        places.append(place)
        first_word.append(heads + total)
        total += len(hashes)
    words, places, heads = np.concatenate(words), np.concatenate(places), np.concatenate(first_word)
    # Only sentences with a weighted feature differ from the bias; the others of a document are counted.
    owner = np.repeat(np.arange(n), sentences)
    sentence, where = np.unique(np.searchsorted(heads, words, side="right") - 1, return_inverse=True)
    document = owner[sentence] if len(owner) else np.zeros(0, np.int64)
    plain = sentences - np.bincount(document, minlength=n)
    word_start = np.flatnonzero(np.diff(words, prepend=-1))
    per_word = np.diff(np.append(word_start, len(words)))
    seen_w, seen_b = np.full(len(keys), 1e-8), 1e-8
    for _ in range(rounds):
        logits = np.full(len(sentence), model.bias)
        strong = np.arange(len(words))
        if len(words):
            value = model.weights[places]
            peak = np.maximum.reduceat(value, word_start)
            # A word counts with its strongest feature; at the start all are alike.
            strong = np.flatnonzero(value == np.repeat(peak, per_word))
            logits += np.bincount(where[word_start], peak, len(sentence))
        clean = -np.bincount(document, np.logaddexp(0, logits), n) - plain * np.logaddexp(0, model.bias)
        clean = np.minimum(clean, -1e-9)
        # d loss / d logit: p for a clean document, -p * P(clean) / P(toxic) for a toxic one.
        pull = np.where(labels == 1, -np.exp(clean) / -np.expm1(clean), 1.0) / n
        slope = pull[document] / (1 + np.exp(-logits))
        if len(words):
            g = np.bincount(places[strong], slope[where[strong]], len(keys))
            seen_w = 0.98 * seen_w + 0.02 * g * g
            model.weights = np.maximum(model.weights - rate * (g + sparsity * (g != 0)) / (np.sqrt(seen_w) + 1e-5), 0).astype(np.float32)
        all_ = slope.sum() + (pull * plain).sum() / (1 + np.exp(-model.bias))
        seen_b = 0.98 * seen_b + 0.02 * all_**2
        model.bias -= 0.3 * rate * all_ / (np.sqrt(seen_b) + 1e-5)
    return Model(keys[model.weights > 0], model.weights[model.weights > 0], float(model.bias))


def trained(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES) -> Model:
    """A model from a bounded sample of labelled documents that are not held out."""
    return trained_in_task(labelled_rows(docs, labels, label, rows, max_bytes), fitted)


def toxicity_scores(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted, offending``.

    ``score`` is the noisy-or of the sentences' scores over the whole text. ``offending`` has ``start, end, score`` of the
    sentences that are toxic by themselves, in code points, the end exclusive.

    Null and empty texts have no sentence and score 0, unless there was nothing to learn from: then all rows have the share
    of toxic labels. Texts may be of any length. Null ids are kept and count as held out; repeated rows are kept; other columns are not read; an empty
    table gives no rows.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    known = (model.keys, model.weights, model.bias, model.constant)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*known)
        for batch in batches:
            texts = batch.column(1)
            data, offsets = buffers(texts)
            scores, spans = np.zeros(len(batch)), [[] for _ in range(len(batch))]
            if own.constant is not None:
                scores[:] = own.constant
            else:
                for first, last, features, heads, sentences, starts, ends in instances(texts):
                    logits = sentence_logits(own, features, heads)
                    scores[first:last] = np.clip(-np.expm1(clean_odds(logits, sentences)), 0, 1)
                    hits = np.flatnonzero(logits >= 0)
                    if len(hits):
                        rows = np.repeat(np.arange(first, last), sentences)
                        finish = np.append(heads[1:], len(features)) - 1
                        base = int(offsets[first])
                        points = row_ends((data[base : int(offsets[last])] & 0xC0) != 0x80)
                        for h in hits.tolist():
                            row = int(rows[h])
                            zero = points[int(offsets[row]) - base]
                            spans[row].append({"start": int(points[starts[heads[h]]] - zero), "end": int(points[ends[finish[h]]] - zero), "score": float(1 / (1 + np.exp(-logits[h])))})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(spans, span)], ["doc_id", "score", "offending"])
        give_back()

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(score, f"doc_id {kind}, score double, offending array<struct<start:bigint,end:bigint,score:double>>")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offending")


def filtered(docs: DataFrame, model: Model, text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text scores below ``threshold``; rows are filtered batch by batch.

    With nothing to learn from, all rows are kept.
    """
    if model.constant is not None:
        return docs
    known = (model.keys, model.weights, model.bias)
    place = docs.columns.index(text_column)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*known)
        for batch in batches:
            scores = np.zeros(len(batch))
            for first, last, hashes, heads, sentences, _, _ in instances(batch.column(place)):
                scores[first:last] = -np.expm1(clean_odds(sentence_logits(own, hashes, heads), sentences))
            yield batch.filter(pa.array(scores < threshold))
        give_back()

    return docs.mapInArrow(clean, docs.schema)
