"""Merkle manifest of a dataset: a tree over the rows of each group, a tree over the groups, and every row's proof."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelward.session import fresh_folder

#: Levels of a block: with two nodes to a run, a block has 256 leaves at most.
LEVELS = 8
#: The columns of a leaf, and the divisor that marks rows for the tampering test.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER = 7

STEPS = "array<struct<before: string, after: string>>"


def hashed(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts put together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the bytes of the value as text, a colon and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, id_column: str, group_column: str, count_column: str, fields: tuple[str, ...]) -> DataFrame:
    """``id, group, hash, altered``: the hash of every row, and where rows are tampered with, that of the altered row."""
    whole = [field(F.col(c)) for c in fields]
    more = [field(F.col(c).cast("decimal(20,0)") + 1 if c == count_column else F.col(c)) for c in fields]
    tampered = F.crc32(F.col(id_column).cast("string").cast("binary")) % TAMPER == 0
    return docs.select(F.col(id_column).alias("id"), F.col(group_column).alias("group"), hashed(*whole).alias("hash"), F.when(tampered, hashed(*more)).alias("altered"))


def ranked(rows: DataFrame, order: list[str], folder: str) -> tuple[DataFrame, int]:
    """Adds ``rank``, from 0 in each ``group`` along ``order``; also returns the number of rows.

    Rows are sorted by ranges, so a large group lies in many of them. Each range numbers its own groups, and only its first
    group goes on from the ranges before: one number for each range.
    """

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n, head = TaskContext.get().partitionId(), None, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            # Null and text groups compare apart by their first letter.
            marks = pc.fill_null(pc.binary_join_element_wise("=", batch.column("group").cast(pa.string()), ""), "-")
            starts = np.ones(batch.num_rows, bool)
            starts[1:] = pc.not_equal(marks[1:], marks[:-1]).to_numpy(zero_copy_only=False)
            starts[0] = last != marks[0].as_py()
            if last is None:
                starts[0] = False
            at = np.arange(batch.num_rows)
            begun = np.maximum.accumulate(np.where(starts, at, -1))
            local = np.where(begun < 0, at + n, at - begun)
            heads = (begun < 0) & head
            last, n, head = marks[-1].as_py(), int(local[-1]) + 1, bool(heads[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part)), pa.array(local), pa.array(heads)], [*batch.schema.names, "part", "local", "head"])

    keys = ["group", *order]
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    sorted_rows.mapInArrow(numbered, f"{kinds}, part bigint, local bigint, head boolean").write.parquet(folder)
    placed = rows.sparkSession.read.parquet(folder)
    groups = placed.groupBy("part", "group").agg(F.count(F.lit(1)).alias("n"), F.max("head").alias("head"))
    edge = F.struct(F.col("group").isNotNull().alias("known"), "group", F.col("n"))
    # One row for each range.
    parts = groups.groupBy("part").agg(F.max(F.when(F.col("head"), edge)).alias("first"), F.max(edge).alias("last"), F.sum("n").alias("n")).orderBy("part").collect()
    offsets, carried, of = {}, 0, None
    for p in parts:
        before = carried if of is not None and of == (p["first"]["known"], p["first"]["group"]) else 0
        offsets[p["part"]] = before
        of, only = (p["last"]["known"], p["last"]["group"]), p["n"] == p["first"]["n"]
        carried = p["last"]["n"] + (before if only else 0)
    start = F.element_at(F.create_map(*[F.lit(v) for pair in offsets.items() for v in pair]), F.col("part")) if offsets else F.lit(0)
    rank = (F.col("local") + F.when(F.col("head"), start).otherwise(0)).cast("long")
    return placed.select(*rows.columns, rank.alias("rank")), sum(p["n"] for p in parts)


def trees(nodes: DataFrame, payload: list[str], fan: int, levels: int) -> DataFrame:
    """One row per block of ``fan ** levels`` ranks of a group: ``group, block, size, tree, depth, hash``.

    The rank's digits are columns, grouped away one after another; each grouping nests the structs of the one before. All
    groupings share one shuffle by group and block. ``depth`` is the number of levels that count: in a group's first block
    those until one node is left, as a first block that is not full is the only one. ``hash`` is that of the tree there.
    """
    digits = [f"_d{j}" for j in range(levels)]
    rows = nodes.select(
        "group", F.floor(F.col("rank") / fan**levels).cast("long").alias("block"), *[(F.floor(F.col("rank") / fan**j) % fan).cast("int").alias(d) for j, d in enumerate(digits)], "hash", *payload
    ).repartition("group", "block")
    nested = rows.select("group", "block", *digits, F.struct(F.col(digits[0]).alias("digit"), "hash", *payload).alias("node"), F.lit(1).cast("long").alias("size"))
    for j in range(levels):
        held = nested.groupBy("group", "block", *digits[j + 1 :]).agg(F.sort_array(F.collect_list("node")).alias("kids"), F.sum("size").alias("size"))
        digit = F.col(digits[j + 1]) if j + 1 < levels else F.lit(0)
        node = F.struct(digit.alias("digit"), hashed(F.array_join("kids.hash", "")).alias("hash"), "kids")
        nested = held.select("group", "block", *digits[j + 1 :], node.alias("node"), "size")
    depth, spine, root = F.lit(0), F.col("node"), None
    for j in range(levels, -1, -1):
        fits = F.col("size") > fan ** (j - 1) if j else F.lit(True)
        depth = F.when((F.col("block") == 0) & (F.col("size") <= fan**j), j).otherwise(depth) if j < levels else F.lit(levels)
        root = F.when((F.col("block") > 0) | fits, spine["hash"]) if root is None else root.when(fits, spine["hash"])
        spine = F.get(spine["kids"], F.lit(0)) if j else spine
    return nested.select("group", "block", "size", F.col("node").alias("tree"), depth.cast("int").alias("depth"), root.alias("hash"))


def paths(placed: DataFrame, payload: list[str], fan: int, levels: int) -> DataFrame:
    """One row per node at the foot of the trees: its payload, ``group, rank, hash``, and ``above`` with its steps before.

    A step has the hashes of a node's run before and after it, put together. ``placed`` has trees and ``above``: the steps
    from the tree's root on, and whatever else belongs to the whole block.
    """

    def emitted(node: Column, level: int, steps: Column, place: Column) -> Column:
        kids = node["kids"]
        joined = lambda part: F.array_join(F.transform(part, lambda k: k["hash"]), "")

        def one(kid: Column, i: Column) -> Column:
            step = F.struct(joined(F.slice(kids, F.lit(1), i)).alias("before"), joined(F.slice(kids, i + 2, F.lit(fan))).alias("after"))
            way, at = F.concat(F.array(step), steps), place * fan + kid["digit"]
            if level > 1:
                return emitted(kid, level - 1, way, at)
            return F.array(F.struct(kid.alias("leaf"), way.alias("steps"), at.alias("rank")))

        return F.flatten(F.transform(kids, one))

    found = F.explode(emitted(F.col("tree"), levels, F.array().cast(STEPS), F.col("block"))).alias("found")
    rows = placed.select("group", "depth", "above", found)
    steps = F.concat(F.slice("found.steps", F.lit(1), F.col("depth")), "above.steps")
    return rows.select("group", F.col("found.rank").alias("rank"), F.col("found.leaf.hash").alias("hash"), *[F.col(f"found.leaf.{c}").alias(c) for c in payload], F.col("above").withField("steps", steps).alias("above"))


def delivered(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Blocks with what stands above them: both rows of a group and block meet in one grouping."""
    both = blocks.select("group", "block", F.struct("tree", "depth").alias("own")).unionByName(above.select("group", "block", "above"), allowMissingColumns=True)
    met = both.groupBy("group", "block").agg(F.first("own", ignorenulls=True).alias("own"), F.first("above", ignorenulls=True).alias("above"))
    return met.select("group", "block", "own.tree", "own.depth", "above")


def rounds(n: int, fan: int, levels: int) -> int:
    """How often ``n`` nodes are grouped in blocks until one block is left."""
    k = 1
    while fan ** (levels * k) < n:
        k += 1
    return k


def climbed(nodes: DataFrame, payload: list[str], n: int, folder: str, fan: int, levels: int) -> list[tuple[DataFrame, list[str]]]:
    """The trees of each round, written to the folder: blocks of nodes, blocks of these blocks, until a group is one block."""
    spark, out = nodes.sparkSession, []
    for k in range(rounds(n, fan, levels)):
        trees(nodes, payload, fan, levels).write.parquet(f"{folder}/{k}")
        written = spark.read.parquet(f"{folder}/{k}")
        out.append((written, payload))
        nodes, payload = written.select("group", F.col("block").alias("rank"), "hash"), []
    return out


def descended(climb: list[tuple[DataFrame, list[str]]], above: DataFrame, fan: int, levels: int) -> DataFrame:
    """The nodes at the foot of all rounds with their steps, from what stands above each group."""
    above = above.select("group", F.lit(0).cast("long").alias("block"), "above")
    for blocks, payload in reversed(climb):
        found = paths(delivered(blocks, above), payload, fan, levels)
        above = found.select("group", F.col("rank").alias("block"), "above")
    return found


def merkle_manifest(docs: DataFrame, *, fan: int = 2, levels: int = LEVELS, id_column: str = "doc_id", group_column: str = "lang", count_column: str = "n_chars", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``id, leaf, subroot, root, proof, proof_sha256, folded_root, verified`` of every row.

    A leaf is the hash of a row's ``fields``. The leaves of a group ascend by id; every ``fan`` nodes in succession become
    their hash until one is left, the group's subroot; subroots in the order of groups give the root likewise. ``proof`` has
    a step for each level: the hashes of the node's run before and after it. ``folded_root`` is the root computed anew from
    the row's leaf and proof, with ``count_column`` raised by one in rows whose id's checksum is divisible by 7, which
    ``verified`` tells from the others.

    Trees are built and read in blocks of ``fan ** levels`` nodes, then in blocks of these blocks, so no row or task holds a
    whole group. Texts are read once and leave only their hashes.

    A null field has a leaf of its own; rows with a null id come first in their group and are not altered; null groups come
    first. A null count stays null when altered. Equal rows are leaves each; rows that share an id are ordered by their
    leaves. Texts may be empty or of any length. Other columns are not read, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = fresh_folder(spark, "merkle")
    leaves(docs, id_column, group_column, count_column, fields).write.parquet(f"{folder}/leaves")
    nodes, n = ranked(spark.read.parquet(f"{folder}/leaves"), ["id", "hash"], f"{folder}/ranked")
    payload = ["id", "altered"]
    climb = climbed(nodes, payload, n, f"{folder}/trees", fan, levels)
    # The last round has one block for each group.
    groups = climb[-1][0].select(F.lit(None).cast("string").alias("group"), F.col("group").alias("name"), "hash")
    over, m = ranked(groups, ["name"], f"{folder}/groups")
    top = climbed(over, ["name"], m, f"{folder}/top", fan, levels)
    root = top[-1][0].select("group", F.struct(F.array().cast(STEPS).alias("steps"), F.col("hash").alias("root")).alias("above"))
    found = descended(top, root, fan, levels)
    above = found.select(F.col("name").alias("group"), F.struct("above.steps", "above.root", F.col("hash").alias("subroot")).alias("above"))
    rows = descended(climb, above, fan, levels).select("id", "hash", "altered", "above.*")
    beside = F.transform("steps", lambda s: F.concat(s["before"], s["after"]))
    folded = F.aggregate("steps", F.coalesce("altered", "hash"), lambda h, s: hashed(s["before"], h, s["after"]))
    done = rows.select(
        F.col("id").alias(id_column), F.col("hash").alias("leaf"), "subroot", "root", F.col("steps").alias("proof"), hashed(F.array_join(beside, "")).alias("proof_sha256"), folded.alias("folded_root")
    )
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))
