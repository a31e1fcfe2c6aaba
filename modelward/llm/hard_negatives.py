"""Hard negatives by exact search over blocks of vectors that lie along a Hilbert curve."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modelward.llm.arrays import whole_ids
from modelward.session import fresh_folder

#: Rows of a block; it has one zone map.
BLOCK_ROWS = 512
#: Bytes of anchor vectors that are sent to all tasks at once; more anchors are searched in further rounds.
ANCHOR_BYTES = 4 << 20
#: Cells of the curve along each axis, as a power of two.
BITS = 2
#: Hits that a task gathers before it cuts them down.
GATHERED = 1 << 16
#: Sums of integers are exact in a double below this.
EXACT = float(1 << 53)

BLOCKS = "shard int, block int, ids array<bigint>, labels array<bigint>, anchors array<boolean>, vectors binary, low array<bigint>, high array<bigint>"
ANCHORS = "shard int, block int, anchor_id bigint, label bigint, vector binary, reach double"
HITS = "anchor int, slot int, id bigint, score bigint"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of cell numbers along the Hilbert curve, as bytes that sort in its order.

    The curve's rotations are undone from the highest bit down, for all rows at once; what is left is a Gray code.
    """
    x = cells.astype(np.uint32).T.copy()
    if not x.size:
        return np.zeros((cells.shape[0], 0), np.uint8)
    high = 1 << (bits - 1)
    q = high
    while q > 1:
        below = np.uint32(q - 1)
        for axis in range(len(x)):
            turned = (x[axis] & q) != 0
            swap = np.where(turned, np.uint32(0), (x[0] ^ x[axis]) & below)
            x[0] ^= np.where(turned, below, swap)
            x[axis] ^= swap
        q >>= 1
    np.bitwise_xor.accumulate(x, axis=0, out=x)
    flips = np.zeros(x.shape[1], np.uint32)
    q = high
    while q > 1:
        flips ^= np.where((x[-1] & q) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= flips
    planes = [(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of integers as rows of one width; shorter vectors end in zeros."""
    lengths = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten())
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest score that each anchor can have with a vector between ``low`` and ``high``."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return up @ low + down @ high, up @ high + down @ low


@dataclass
class Search:
    """What the tasks of a round need: vectors, and for each a few windows of scores.

    ``least`` and ``most`` have a row per anchor and a column per window; an empty window has ``least`` above ``most``.
    """

    vectors: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    least: np.ndarray
    most: np.ndarray
    same_label: bool
    take: int


class Best:
    """The best few hits of each (anchor, window) among the blocks seen so far, and the score that a further one needs."""

    def __init__(self, search: Search) -> None:
        self.search = search
        self.need = search.least.astype(float).copy()
        self.key = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.float64)
        self.fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def open(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The anchors that have a window which a block of these bounds can reach."""
        least, most = bounds(self.search.vectors, low, high)
        need = self.need
        return np.flatnonzero(((need <= self.search.most) & (most[:, None] >= need) & (least[:, None] <= self.search.most)).any(axis=1))

    def add(self, who: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        s = self.search
        need, most = self.need[who], s.most[who]
        empty = need > most
        floor, ceiling = np.where(empty, np.inf, need).min(axis=1), np.where(empty, -np.inf, most).max(axis=1)
        scores = s.vectors[who] @ vectors.T
        near = (scores >= floor[:, None]) & (scores <= ceiling[:, None]) & ((s.labels[who][:, None] == labels) == s.same_label)
        if s.same_label:
            near &= s.ids[who][:, None] != ids
        row, col = np.nonzero(near)
        found = scores[row, col]
        for slot in range(need.shape[1]):
            fits = (found >= need[row, slot]) & (found <= most[row, slot])
            if fits.any():
                self.fresh.append((who[row[fits]] * need.shape[1] + slot, ids[col[fits]], found[fits]))
                self.held += int(fits.sum())
        if self.held >= GATHERED or (self.held and not len(self.key)):
            self.cut()

    def cut(self) -> None:
        """Keeps the best of each key: higher scores first, then smaller ids."""
        if not self.fresh:
            return
        key, ids, score = (np.concatenate(x) for x in zip((self.key, self.id, self.score), *self.fresh))
        self.fresh, self.held = [], 0
        order = np.lexsort((ids, -score, key))
        key, ids, score = key[order], ids[order], score[order]
        first = np.searchsorted(key, key, side="left")
        place = np.arange(len(key)) - first
        stays = place < self.search.take
        last = place == self.search.take - 1
        self.need.reshape(-1)[key[last]] = score[last]
        self.key, self.id, self.score = key[stays], ids[stays], score[stays]

    def batch(self) -> pa.RecordBatch:
        self.cut()
        slots = self.need.shape[1]
        return pa.RecordBatch.from_arrays([pa.array((self.key // slots).astype(np.int32)), pa.array((self.key % slots).astype(np.int32)), pa.array(self.id), pa.array(self.score.astype(np.int64))], ["anchor", "slot", "id", "score"])


def integer_vectors(vectors: DataFrame, is_anchor: Column, scale: int, id_column: str, label_column: str, vector_column: str) -> DataFrame:
    """``vec_id, label, vector, anchor`` of the rows that take part; components are whole numbers."""
    for name in (id_column, label_column):
        whole_ids(vectors, name)
    vector = F.col(vector_column)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & vector.isNotNull() & finite)
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), whole.alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))


def axis_statistics(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each component over all rows, from one row of sums per task and component."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(0), np.zeros((0, 3))
        for batch in batches:
            width = int(np.max(np.asarray(batch.column(0).value_lengths()), initial=0))
            x = matrix(batch.column(0), width).astype(float)
            grown = np.zeros((max(width, len(total)), 3))
            grown[: len(total)] = total
            if len(x):
                grown[:width, 0] += x.sum(axis=0)
                grown[:width, 1] += (x * x).sum(axis=0)
                grown[:width, 2] = np.maximum(grown[:width, 2], np.abs(x).max(axis=0))
            n, total = np.append(n, len(x)), grown
        columns = [np.arange(len(total), dtype=np.int32), *total.T, np.full(len(total), n.sum())]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["axis", "s", "ss", "largest", "n"])

    parts = rows.select("vector").mapInArrow(sums, "axis int, s double, ss double, largest double, n double")
    # One row for each component.
    axes = parts.groupBy("axis").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.max("largest").alias("largest"), F.sum("n").alias("n")).orderBy("axis").collect()
    s, ss, largest, n = (np.array([r[c] for r in axes], float) for c in ("s", "ss", "largest", "n"))
    if (largest**2).sum() >= EXACT:
        raise ValueError("scores of these vectors are not exact: scaled components must give inner products below 2**53")
    mean = s / np.maximum(n, 1)
    return mean, np.sqrt(np.maximum(ss / np.maximum(n, 1) - mean**2, 0))


def write_blocks(rows: DataFrame, folder: str, block_rows: int = BLOCK_ROWS, bits: int = BITS) -> int:
    """Writes the rows in blocks along the curve, a folder per shard; returns the number of components.

    A shard is a range of the curve, so near vectors lie in one block and many equal ones spread over blocks by their id.
    Rows equal in id, label and vector are one. Each block has the least and the largest value of every component.
    """
    mean, deviation = axis_statistics(rows)
    width, cells = len(mean), 1 << bits
    step = np.where(deviation > 0, 4 * deviation / cells, 1.0)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vector"), width)
            cell = np.clip(np.floor((x - (mean - 2 * deviation)) / step), 0, cells - 1)
            keys = pa.array([k.tobytes() for k in hilbert_keys(cell, bits)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], [*batch.schema.names, "key"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block = TaskContext.get().partitionId(), 0
        ids, labels, flags, vectors = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros((0, width), np.int64)

        def made(n: int) -> pa.RecordBatch:
            x = vectors[:n]
            one = [[shard], [block], [ids[:n].tolist()], [labels[:n].tolist()], [flags[:n].tolist()], [x.astype("<i4").tobytes()], [x.min(axis=0, initial=1 << 31).tolist()], [x.max(axis=0, initial=-(1 << 31)).tolist()]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(one, kinds)], [c.split()[0] for c in BLOCKS.split(", ")])

        last = None
        for batch in batches:
            i, lab, f, x = np.asarray(batch.column("vec_id")), np.asarray(batch.column("label")), batch.column("anchor").to_numpy(zero_copy_only=False), matrix(batch.column("vector"), width)
            if len(i):
                same = np.zeros(len(i), bool)
                same[1:] = (i[1:] == i[:-1]) & (lab[1:] == lab[:-1]) & (x[1:] == x[:-1]).all(axis=1)
                same[0] = last is not None and last[0] == i[0] and last[1] == lab[0] and (last[2] == x[0]).all()
                last = (i[-1], lab[-1], x[-1].copy())
                new = ~same
                ids, labels, flags, vectors = np.append(ids, i[new]), np.append(labels, lab[new]), np.append(flags, f[new]), np.concatenate([vectors, x[new]])
            while len(ids) >= block_rows:
                yield made(block_rows)
                block += 1
                ids, labels, flags, vectors = ids[block_rows:], labels[block_rows:], flags[block_rows:], vectors[block_rows:]
        if len(ids):
            yield made(len(ids))

    placed = rows.mapInArrow(keyed, "vec_id bigint, label bigint, vector array<bigint>, anchor boolean, key binary")
    ordered = placed.repartitionByRange("key", "vec_id").sortWithinPartitions("key", "vec_id", "label", "vector")
    ordered.mapInArrow(blocks, BLOCKS).write.partitionBy("shard").parquet(folder)
    return width


def block_arrays(batch: pa.RecordBatch, row: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and vectors of one block."""
    ids, labels = (np.asarray(batch.column(c)[row].values) for c in ("ids", "labels"))
    return ids, labels, np.frombuffer(batch.column("vectors")[row].as_buffer(), "<i4").reshape(len(ids), width).astype(float)


def write_anchors(blocks: DataFrame, folder: str, width: int, positives: int, chunk: int) -> int:
    """Writes the anchors of the blocks, ``chunk`` rows at most to a folder; returns the number of folders.

    ``reach`` is the score of an anchor's last positive inside its own block: no row below it can be a positive.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels, x = block_arrays(batch, row, width)
                at = np.flatnonzero(np.asarray(batch.column("anchors")[row].values.to_numpy(zero_copy_only=False)))
                if not len(at):
                    continue
                scores = np.where((labels[at][:, None] == labels) & (ids[at][:, None] != ids), x[at] @ x.T, -np.inf)
                reach = np.sort(scores, axis=1)[:, -positives] if len(ids) >= positives else np.full(len(at), -np.inf)
                n = len(at)
                columns = [np.full(n, batch.column("shard")[row].as_py(), np.int32), np.full(n, batch.column("block")[row].as_py(), np.int32), ids[at], labels[at]]
                vectors = pa.array([v.tobytes() for v in x[at].astype("<i4")], pa.binary())
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), vectors, pa.array(reach)], [c.split()[0] for c in ANCHORS.split(", ")])

    found = blocks.select("shard", "block", "ids", "labels", "anchors", "vectors").mapInArrow(own, ANCHORS)
    # One row for each shard.
    sizes = blocks.select("shard", F.size(F.filter("anchors", lambda a: a)).alias("n")).groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect()
    before, total = {}, 0
    for r in sizes:
        before[r["shard"]] = total
        total += r["n"]
    if not total:
        return 0
    first = F.element_at(F.create_map(*[F.lit(v) for pair in before.items() for v in pair]), F.col("shard"))
    place = first + F.row_number().over(Window.partitionBy("shard").orderBy("block", "anchor_id", "label", "vector")) - 1
    found.withColumn("chunk", F.floor(place / chunk).cast("int")).write.partitionBy("chunk").parquet(folder)
    return -(-total // chunk)


def reached_shards(blocks: DataFrame, search: Search) -> list[int]:
    """The shards with a block that a window of some anchor can reach; only the zone maps are read."""
    shared = blocks.sparkSession.sparkContext.broadcast(search)

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, seen = Best(shared.value), set()
        for batch in batches:
            for row in range(batch.num_rows):
                shard = batch.column("shard")[row].as_py()
                if shard not in seen and len(best.open(*(np.asarray(batch.column(c)[row].values) for c in ("low", "high")))):
                    seen.add(shard)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int32())], ["shard"])

    found = sorted(r["shard"] for r in blocks.select("shard", "low", "high").mapInArrow(reached, "shard int").distinct().collect())
    shared.destroy()
    return found


def best_hits(blocks: DataFrame, search: Search, width: int) -> DataFrame:
    """The best hits of each (anchor, window): each task returns its best few, of which the best few stay."""
    shared = blocks.sparkSession.sparkContext.broadcast(search)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(shared.value)
        for batch in batches:
            for row in range(batch.num_rows):
                who = best.open(*(np.asarray(batch.column(c)[row].values) for c in ("low", "high")))
                if len(who):
                    best.add(who, *block_arrays(batch, row, width))
        yield best.batch()

    hits = blocks.where(F.col("shard").isin(reached_shards(blocks, search))).select("ids", "labels", "vectors", "low", "high").mapInArrow(searched, HITS)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= search.take)


def loaded_anchors(anchors: DataFrame, width: int) -> tuple[np.ndarray, ...]:
    """Ids, labels, vectors and reach of one chunk, in a fixed order."""
    t = anchors.select("anchor_id", "label", "vector", "reach").orderBy("anchor_id", "label", "vector").toArrow()
    vectors = np.frombuffer(b"".join(t["vector"].to_pylist()), "<i4").reshape(t.num_rows, width).astype(float)
    return np.asarray(t["anchor_id"]), np.asarray(t["label"]), vectors, np.asarray(t["reach"], dtype=float)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), scale: int = 256,
    id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding", block_rows: int = BLOCK_ROWS, anchor_bytes: int = ANCHOR_BYTES,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of each anchor's hard negatives.

    A score is the inner product of components ``floor(scale * x)``. Positives of an anchor are its best ``positives`` other
    rows of its label; for each, the best ``negatives`` rows of other labels are taken whose score lies between the window's
    percentages of the positive's. Ties go to the smaller id. The search is exact: every row is in a block, and a block is
    passed over only if interval arithmetic over its zone map shows that no window of the anchor reaches it. Anchors are sent
    to the tasks in rounds of a fixed number of bytes, each of which passes over the blocks twice: for positives, then for
    negatives. A shard that no window reaches is not read.

    Rows without an id, a label or a vector, or with a null or non-finite component, take no part; ``is_anchor`` may be
    null. Ids and labels must be whole numbers. Rows equal in id, label and vector are one; other rows that share an id are
    rows of their own, and never positives of each other. Shorter vectors count as ending in zeros, an empty one scores 0.
    Anchors without positives or negatives give no row, nor does an empty table. Other columns are not read. Inner products
    that may reach 2**53 are refused.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, is_anchor, scale, id_column, label_column, vector_column)
    folder = fresh_folder(spark, "hard_negatives")
    width = write_blocks(rows, f"{folder}/blocks", block_rows)
    blocks = read_blocks(spark, f"{folder}/blocks")
    chunks = write_anchors(blocks, f"{folder}/anchors", width, positives, max(1, anchor_bytes // (8 * max(1, width))))
    for chunk in range(chunks):
        ids, labels, x, reach = loaded_anchors(spark.read.schema(f"{ANCHORS}, chunk int").parquet(f"{folder}/anchors").where(F.col("chunk") == chunk), width)
        found = best_hits(blocks, Search(x, ids, labels, reach[:, None], np.full((len(ids), 1), np.inf), True, positives), width)
        # At most ``positives`` rows for each anchor of the round.
        near = found.select("anchor", (F.col("rank") - 1).alias("slot"), "id", "score").toArrow()
        anchor, slot, positive, score = (np.asarray(near[c], dtype=np.int64) for c in ("anchor", "slot", "id", "score"))
        least, most = np.full((len(ids), positives), np.inf), np.full((len(ids), positives), -np.inf)
        least[anchor, slot], most[anchor, slot] = -((-window[0] * score) // 100), window[1] * score // 100
        hits = best_hits(blocks, Search(x, ids, labels, least, most, False, negatives), width)
        pairs = spark.createDataFrame(pa.table({"anchor": anchor.astype(np.int32), "slot": slot.astype(np.int32), "anchor_id": ids[anchor], "positive_id": positive, "positive_score": score}))
        joined = hits.join(F.broadcast(pairs), ["anchor", "slot"])
        joined.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{folder}/found/chunk={chunk}")
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    return spark.read.schema(schema).parquet(f"{folder}/found/*") if chunks else spark.createDataFrame([], schema)


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The written blocks; ``shard`` names their folders."""
    return spark.read.schema(BLOCKS).parquet(folder)
