"""Text quality by a convolutional network over bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelward.llm.arrays import BLOCK, buffers, give_back, row_blocks
from modelward.llm.labels import held_out, labelled_rows, trained_in_task

#: Filters see WIDTH bytes, every STRIDE bytes; a chunk is two pieces of PIECE places, and chunks overlap by one piece.
EMBED, WIDTH, STRIDE, FILTERS, PIECE = 4, 8, 2, 24, 64
#: Bounds of the training sample.
TRAIN_ROWS, TRAIN_BYTES = 3000, 1 << 12


@dataclass
class Network:
    params: dict[str, np.ndarray] = field(default_factory=dict)
    #: Given to all documents when there is nothing to learn from.
    constant: float | None = None


def started(seed: int = 11) -> Network:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return Network({"embed": normal(256, EMBED, scale=1.0), "filters": normal(WIDTH * EMBED, FILTERS, scale=(WIDTH * EMBED) ** -0.5), "shift": np.zeros(FILTERS, np.float32), "out": normal(2 * FILTERS, scale=0.1), "bias": np.zeros(1, np.float32)})


def patches(embedded: np.ndarray) -> np.ndarray:
    """The bytes under a filter, place by place."""
    return sliding_window_view(embedded, WIDTH, axis=0)[::STRIDE].transpose(0, 2, 1).reshape(-1, WIDTH * EMBED)


def piece_peaks(params: dict, data: np.ndarray) -> np.ndarray:
    """The largest response of each filter in each piece of one text; a short text is filled up with zero bytes."""
    data = np.concatenate([data, np.zeros(max(0, WIDTH - len(data)), np.uint8)])
    out = []
    step = BLOCK // (PIECE * STRIDE) * PIECE * STRIDE
    for a in range(0, max(len(data) - WIDTH + 1, 1), step):  # a long text in parts that meet at a piece's end
        places = patches(params["embed"][data[a : a + step + WIDTH - 1]])[: step // STRIDE]
        out.append(np.maximum.reduceat(places @ params["filters"], np.arange(0, len(places), PIECE)))
    return np.concatenate(out)


def chunk_peaks(pieces: np.ndarray) -> np.ndarray:
    return np.maximum(pieces[:-1], pieces[1:]) if len(pieces) > 1 else pieces


def pooled(params: dict, pieces: np.ndarray) -> np.ndarray:
    """The largest and the mean response over the chunks of a text."""
    chunks = np.tanh(chunk_peaks(pieces) + params["shift"])
    return np.concatenate([chunks.max(axis=0), chunks.mean(axis=0)])


def document_score(network: Network, data: np.ndarray) -> float:
    x = pooled(network.params, piece_peaks(network.params, data))
    return float(1 / (1 + np.exp(-np.clip(x @ network.params["out"] + network.params["bias"][0], -30, 30))))


def slopes(params: dict, texts: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the log loss over some documents; only the places that won the pooling pass it on."""
    total = {k: np.zeros_like(v) for k, v in params.items()}
    filled = [np.concatenate([t, np.zeros(max(0, WIDTH - len(t)), np.uint8)]) for t in texts]
    sizes = [(len(t) - WIDTH) // STRIDE + 1 for t in filled]
    codes = np.concatenate([sliding_window_view(t, WIDTH)[::STRIDE] for t in filled])
    seen = params["embed"][codes].reshape(len(codes), -1)
    responses = seen @ params["filters"]
    at = 0
    grad_response_rows, grad_response_cols, grad_values = [], [], []
    for n, y in zip(sizes, labels):
        r = responses[at : at + n]
        heads = np.arange(0, n, PIECE)
        # The chunk's winner: argmax over two neighbouring pieces.
        winners = np.stack([np.argmax(r[h : h + 2 * PIECE], axis=0) + h for h in (heads[:-1] if len(heads) > 1 else heads)])
        act = np.tanh(np.take_along_axis(r, winners, axis=0) + params["shift"])
        top = act.argmax(axis=0)
        x = np.concatenate([act.max(axis=0), act.mean(axis=0)])
        p = 1 / (1 + np.exp(-np.clip(x @ params["out"] + params["bias"][0], -30, 30)))
        d = np.float32(p - y)
        total["out"] += d * x
        total["bias"] += d
        back = np.tile(d * params["out"][FILTERS:] / len(act), (len(act), 1)).astype(np.float32)
        back[top, np.arange(FILTERS)] += d * params["out"][:FILTERS]
        back *= 1 - act**2
        total["shift"] += back.sum(axis=0)
        grad_response_rows.append((winners + at).ravel())
        grad_response_cols.append(np.tile(np.arange(FILTERS), len(act)))
        grad_values.append(back.ravel())
        at += n
    rows, cols, values = np.concatenate(grad_response_rows), np.concatenate(grad_response_cols), np.concatenate(grad_values)
    for f in range(FILTERS):
        mine = cols == f
        total["filters"][:, f] = values[mine] @ seen[rows[mine]]
    spread = (values[:, None] * params["filters"].T[cols]).reshape(-1, EMBED)
    for e in range(EMBED):
        total["embed"][:, e] = np.bincount(codes[rows].ravel(), spread[:, e], 256)
    return {k: v / len(texts) for k, v in total.items()}


def fitted(texts: list[np.ndarray], labels: np.ndarray, steps: int = 320, batch: int = 48, rate: float = 0.01, seed: int = 5) -> Network:
    """Adam over shuffled batches, from a fixed seed; both classes weigh alike through how often they are drawn."""
    n = len(labels)
    if n == 0 or labels.min() == labels.max():
        return Network({}, (float(labels.sum()) + 1) / (n + 2))
    network, rng = started(), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in network.params.items()}
    second = {k: np.zeros_like(v) for k, v in network.params.items()}
    zeros, ones = np.flatnonzero(labels == 0), np.flatnonzero(labels != 0)
    # The rarer class is drawn up to three times a turn.
    rare, common = sorted((zeros, ones), key=len)
    times = min(3, max(1, len(common) // len(rare)))
    done = 0
    while done < steps:
        order = rng.permutation(np.concatenate([common, *[rare] * times]))
        for a in range(0, min(len(order), (steps - done) * batch), batch):
            mine = order[a : a + batch]
            g = slopes(network.params, [texts[i] for i in mine], labels[mine])
            done += 1
            now = rate * (1 - done / (steps + 1))
            for k, v in network.params.items():
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
                v -= now * (first[k] / (1 - 0.9**done)) / (np.sqrt(second[k] / (1 - 0.99**done)) + 1e-7)
    return network


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES) -> Network:
    """A network from a bounded sample of labelled documents that are not held out."""
    return trained_in_task(labelled_rows(docs, labels, label, rows, max_bytes), fitted_texts)


def fitted_texts(texts: pa.Array, labels: np.ndarray) -> Network:
    data, offsets = buffers(texts) if len(texts) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    return fitted([data[a:b] for a, b in zip(offsets[:-1], offsets[1:])], labels)


def quality_scores(docs: DataFrame, network: Network, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    The score sees every byte of the text, in overlapping chunks. Null and empty texts are scored as zero bytes; with
    nothing to learn from, all rows have the share of good labels. Null ids are kept and count as held out; repeated rows
    are kept; other columns are not read; an empty table gives no rows.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    params, constant = network.params, network.constant

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(params, constant)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            scores = np.full(len(batch), own.constant if own.constant is not None else 0.0)
            if own.constant is None:
                for first, last in row_blocks(offsets):
                    for i in range(first, last):
                        scores[i] = document_score(own, data[int(offsets[i]) : int(offsets[i + 1])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])
        give_back()

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(score, f"doc_id {kind}, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
