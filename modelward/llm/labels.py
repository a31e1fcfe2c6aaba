"""A bounded sample of labelled documents, and training on it in a task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelward.llm.arrays import give_back

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; null ids are."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, max_bytes: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``_id, text, label`` of at most ``rows`` labelled documents that are not held out, of ``rows * max_bytes`` bytes together.

    The documents are the first in the order of a hash of their ids, of those that have a text. If their texts are too large
    together, the longest are left out, whole ones only, and the next ones of up to ``max_bytes`` taken instead. A document
    with several labels has their rounded mean, one with several texts the shortest, the first in order of these. Null labels
    and texts give no row.
    """
    room = rows * max_bytes
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col(id_column))).groupBy(F.col(id_column).alias("_id")).agg(F.round(F.avg(label)).cast("int").alias("label"))
    texts = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("text"), F.octet_length(text_column).alias("size"))
    # Ids and lengths only; no text is shuffled.
    sized = texts.where(F.col("size") <= room).groupBy("_id").agg(F.min("size").alias("size")).join(known, "_id")
    first = lambda found: found.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    both = first(sized).withColumn("short", F.lit(0)).union(first(sized.where(F.col("size") <= max_bytes)).withColumn("short", F.lit(1)))
    # At most 2 * rows rows.
    found = both.select("_id", "size", "label", "short").orderBy("short", F.xxhash64("_id"), "_id").collect()
    taken, left = {}, room
    for r in sorted((r for r in found if not r.short), key=lambda r: r["size"]) + [r for r in found if r.short]:
        if r["_id"] not in taken and len(taken) < rows and r["size"] <= left:
            taken[r["_id"]] = r
            left -= r["size"]
    # As many rows as the bound says, so they can be sent to all tasks.
    kinds = sized.select("_id", "size", "label").schema
    chosen = F.broadcast(docs.sparkSession.createDataFrame([(r["_id"], r["size"], r["label"]) for r in taken.values()], kinds))
    return texts.join(chosen, ["_id", "size"]).groupBy("_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def labelled_sample(*args, **options) -> pa.Table:
    """The same rows, here, in the order of ids."""
    return labelled_rows(*args, **options).orderBy("_id").select("text", "label").toArrow()


def trained_in_task(sample: DataFrame, fit: Callable[[pa.Array, np.ndarray], object]):
    """What ``fit`` makes of the texts and labels of a bounded sample, in the order of ids; they all go to one task.

    The driver gets the model alone.
    """

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches, pa.schema([("text", pa.string()), ("label", pa.int32())])).combine_chunks()
        texts = held["text"].chunk(0) if held.num_rows else pa.array([], pa.string())
        model = fit(texts, held["label"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])
        del held, texts, model
        give_back()

    found = sample.repartition(1).sortWithinPartitions("_id").select("text", "label").mapInArrow(train, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit(pa.array([], pa.string()), np.zeros(0, np.int32))
