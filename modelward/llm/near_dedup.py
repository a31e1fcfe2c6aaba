"""Near duplicates by MinHash: a multi-index Hamming join of b-bit signatures, confirmed on the full shingle sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelward.functions.bloom import bloom_filter, may_hold
from modelward.llm.arrays import FOLDED, give_back, mixed, ragged, row_ends, whole_ids, word_blocks
from modelward.llm.components import connected_components

#: A signature has POSITIONS values of BITS bits, in CHUNKS chunks; ERRORS positions of a chunk may differ.
BITS, CHUNKS, WIDTH, ERRORS = 16, 10, 4, 1
POSITIONS = CHUNKS * WIDTH
#: Signatures that differ in at most so many positions always share a key: if every chunk had more than ERRORS errors, there
#: would be at least CHUNKS * (ERRORS + 1).
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Texts that one task compares with one text, at most; more are split over several groups.
GROUP = 512
#: Rows of a block in which a bucket's classes are compared.
BLOCK_ROWS = 1024
#: Positions of a further chunk that may differ there: with ERRORS + 1 at least in each of the other chunks and these in each
#: of the rest, there would be more than DISTANCE.
MORE_ERRORS = DISTANCE // (CHUNKS - 1)
#: Rows beside the largest component that make a bucket go through the second level of the index: there, a row goes to one
#: bucket for each choice of errors in each other chunk; without it, to one cell for each block of the bucket.
CROWD = BLOCK_ROWS * (CHUNKS - 1) * comb(WIDTH, MORE_ERRORS)
#: Bits for each wanted text of the filter that keeps other texts out of a shuffle, and its least and most bits (8 MiB).
TEXT_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 12, 1 << 26
NO_ID = -(1 << 63)

_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, POSITIONS, dtype=np.uint64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    r"""The sorted distinct 64-bit shingle hashes of each text.

    Words are ``[^\x20\x09-\x0D]+`` with A-Z lower-cased; a text with fewer than ``words`` words has its whole sequence as
    one shingle; one without words has none.
    """
    for _, _, hashes, counts, _, _ in word_blocks(texts, FOLDED):
        bounds = row_ends(counts)
        rolled = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
        for j in range(words):
            rolled = rolled * _MIX + hashes[j : len(hashes) - words + 1 + j] if len(rolled) else rolled
        rolled = mixed(rolled + np.uint64(words))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= words:
                yield np.unique(rolled[a : b - words + 1])
            elif b > a:
                whole = np.zeros(1, np.uint64)
                for h in hashes[a:b]:
                    whole = whole * _MIX + np.array([h], np.uint64)
                yield mixed(whole + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The lowest BITS bits of the smallest hash under each of POSITIONS functions; sets must not be empty."""
    flat, bounds = np.concatenate(sets), row_ends([len(s) for s in sets])[:-1]
    out = np.empty((len(sets), POSITIONS), np.uint16)
    for k, seed in enumerate(_SEEDS):
        out[:, k] = mixed(np.minimum.reduceat((flat ^ seed) * (seed | np.uint64(1)), bounds)) & np.uint64((1 << BITS) - 1)
    return out


def signature_table(docs: DataFrame, words: int, id_column: str, text_column: str) -> DataFrame:
    """``id, mark, n_shingles, set_hi, set_lo, signature``; ``mark`` is a hash of the text, the set hashes name the set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            sizes, high, low = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            marks: list[bytes | None] = [None] * n
            held: list[np.ndarray] = []
            rows: list[int] = []
            total = 0

            def flush() -> None:
                for i, s in zip(rows, signatures(held) if held else ()):
                    marks[i] = s.tobytes()
                held.clear()
                rows.clear()

            for i, found in enumerate(shingle_sets(batch.column(2), words)):
                if len(found):
                    sizes[i] = len(found)
                    high[i], low[i] = mixed(found ^ _SEEDS[0]).sum().view(np.int64), mixed(found ^ _SEEDS[1]).sum().view(np.int64)
                    held.append(found)
                    rows.append(i)
                    total += len(found)
                    if total > 1 << 16:
                        flush()
                        total = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(high), pa.array(low), pa.array(marks, pa.binary())], ["id", "mark", "n_shingles", "set_hi", "set_lo", "signature"])
        give_back()

    return texts_of(docs, id_column, text_column).mapInArrow(sign, "id bigint, mark bigint, n_shingles bigint, set_hi bigint, set_lo bigint, signature binary")


def texts_of(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    whole_ids(docs, id_column)
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _keys(errors: int, *more: Column) -> list[list[Column]]:
    """For each chunk of a signature, a key for each choice of ``errors`` positions, which are left out of it."""
    word = F.hex("signature")
    digits = BITS // 4
    at = [F.substring(word, 1 + p * digits, digits) for p in range(POSITIONS)]
    choices = list(combinations(range(WIDTH), WIDTH - errors))
    return [[F.xxhash64(*more, F.lit(chunk * 64 + k), *[at[chunk * WIDTH + p] for p in kept]) for k, kept in enumerate(choices)] for chunk in range(CHUNKS)]


def chunk_keys(signed: DataFrame) -> DataFrame:
    """``key, id`` rows: for each chunk, each choice of positions that may hold its errors is left out of a key in turn."""
    return signed.select(F.explode(F.array(*[k for chunk in _keys(ERRORS) for k in chunk])).alias("key"), "id")


def second_level(rows: DataFrame, signed: DataFrame) -> DataFrame:
    """Crowded buckets cut into smaller ones, in which all pairs within the distance still meet; ``family, id, component``.

    Rows of a bucket agree in one chunk but for ERRORS positions. Two within DISTANCE also agree in another chunk but for
    MORE_ERRORS positions, as too many would differ otherwise. So each row goes to one bucket for each choice of these
    positions in each other chunk, and rows that share no more than the first key part.
    """
    own = rows.join(signed.select("id", "signature"), "id")
    first = _keys(ERRORS)
    chunk = F.floor((F.array_position(F.array(*[k for c in first for k in c]), F.col("family")) - 1) / len(first[0])).cast("int").alias("chunk")
    finer = [F.when(F.col("chunk") != c, k) for c, keys in enumerate(_keys(MORE_ERRORS, F.col("family"))) for k in keys]
    return several(own.select("*", chunk).select(F.explode(F.array_compact(F.array(*finer))).alias("family"), "id", "component"))


def several(rows: DataFrame) -> DataFrame:
    """The rows of families of two components or more."""
    open_ = rows.groupBy("family").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("family")
    return rows.join(open_, "family", "left_semi")


def signature_distance(left: Column, right: Column) -> Column:
    """Positions in which two signatures differ."""
    width = BITS // 8
    differ = [(F.substring(left, 1 + p * width, width) != F.substring(right, 1 + p * width, width)).cast("int") for p in range(POSITIONS)]
    total = differ[0]
    for d in differ[1:]:
        total = total + d
    return total


def with_texts(rows: DataFrame, wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """``rows`` with the ``text`` of their ``id``; ``wanted`` has ``id, doc, mark`` of every such id, ``texts`` ``doc, mark, text``.

    Most texts are compared with none, so those that a Bloom filter of the wanted ones rules out are not shuffled. The others
    are shuffled once, by the name of the text, and the narrow rows come to them.
    """
    bits = min(max(1 << (TEXT_BITS * wanted.count()).bit_length(), LEAST_BITS), MOST_BITS)
    name = ["doc", "mark"]
    held = texts.where(may_hold(bloom_filter(wanted, name, bits), [F.col(c) for c in name], bits)).dropDuplicates(name)
    return rows.join(wanted, "id").join(held, name).drop(*name)


def confirmed(pairs: DataFrame, heads: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets have ``100 * intersection >= percent * union``; ``heads`` names the texts.

    All texts to be compared with one text ``a`` come behind it in one sorted stream, of which a task holds two sets at a
    time. A text with more than GROUP partners is sent to several streams.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP)).alias("groups"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("group"))
    wanted = dealt.select("a", "group", F.col("b").alias("id"), F.lit(1).alias("role")).union(dealt.select("a", "group", F.col("a").alias("id"), F.lit(0).alias("role")).distinct())
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    named = heads.select("id", "doc", "mark").join(ends, "id", "left_semi").checkpoint()
    rows = with_texts(wanted, named, texts).select("a", "group", "role", "id", "text")
    stream = rows.repartition("a", "group").sortWithinPartitions("a", "group", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, base = None, np.zeros(0, np.uint64)
        for batch in batches:
            left, right = [], []
            roles, ids, heads = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(0).to_pylist()
            for head, role, other, found in zip(heads, roles, ids, shingle_sets(batch.column(4), words)):
                if role == 0:
                    first, base = head, found
                elif head == first:
                    common = len(np.intersect1d(base, found, assume_unique=True))
                    if 100 * common >= percent * (len(base) + len(found) - common):
                        left.append(head)
                        right.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])
        give_back()

    return stream.mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked when their sets of ``words``-word shingles have a Jaccard similarity of ``percent`` or more;
    ``component_id`` is the smallest id reachable over links, and the document with that id is kept.

    Documents with one set are one class from the start. Classes meet in the buckets of a multi-index over their b-bit
    signatures; crowded buckets are cut by further chunks. In a bucket, first every class is compared with the smallest one only; what is linked this way needs
    no more comparing. In buckets that still hold several components, all signatures of different components are compared,
    those within the distance form families, and in a family all texts of different components are. Both happen inside
    tasks, over cells of bounded size, which hand on a spanning forest; no pairs of a whole bucket are written out.

    Equal sets are told by the 128-bit sum of their shingles' hashes and by their size. Ids must be whole numbers; texts may be
    of any length. Null and empty texts, and those of white space alone, have no shingles and are linked with nothing. Rows that share an id
    are one document: it is linked with whatever one of its texts is, and has the shingles of the one with the smallest hash
    of those that have any. Rows with a null id are a document for each distinct text; the smallest id is that of another
    document where there is one, else null, and one of the rows is kept. Other columns are not read; an empty table gives
    no rows.
    """
    back = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    found = near_texts(docs, id_column, text_column, words, percent, one_per_id=True)
    return found.select(back("doc").alias("doc_id"), "n_shingles", back("component").alias("component_id"), "kept")


def near_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, percent: int = 80, one_per_id: bool = False) -> DataFrame:
    """One row per id and text: ``doc, mark, n_shingles, component, kept``; with ``one_per_id`` as `near_duplicates` says.

    ``doc`` is the id, NO_ID for null, ``mark`` the hash of the text. Every id and text is a node of its own. ``component`` is
    the smallest id of a component, NO_ID if all are null, and one of its texts is kept.
    """
    signed = signature_table(docs, words, id_column, text_column)
    # One row per id and text; equal rows are alike in all columns.
    texts = signed.groupBy(F.col("id").alias("doc"), "mark").agg(F.min(F.struct("n_shingles", "set_hi", "set_lo", "signature")).alias("s")).select("doc", "mark", "s.*").checkpoint()
    named = texts.where(F.col("doc") != NO_ID)
    first = F.min(F.struct((F.col("n_shingles") == 0).alias("bare"), "mark"))["mark"].alias("first")
    # Ids of several texts: one of them is the node of that number, the others are numbered by a hash, as null ids are.
    several = named.groupBy("doc").agg(first, F.min("mark").alias("x"), F.max("mark").alias("y")).where("x < y").select("doc", "first").checkpoint()
    hashed = F.xxhash64("doc", "mark")
    node = F.when(F.col("first") != F.col("mark"), hashed).otherwise(F.col("doc")).alias("id")
    columns = ["doc", "mark", "n_shingles", "set_hi", "set_lo", "signature"]
    one = named.join(several, "doc", "left").select(node, *columns).union(texts.where(F.col("doc") == NO_ID).select(hashed.alias("id"), *columns)).checkpoint()
    full = one.where("n_shingles > 0")
    classes = full.groupBy("n_shingles", "set_hi", "set_lo").agg(F.min("id").alias("class"))
    members = full.select("id", "doc", "n_shingles", "set_hi", "set_lo").join(classes, ["n_shingles", "set_hi", "set_lo"]).select("id", "doc", "class")
    heads = one.join(classes.select(F.col("class").alias("id")), "id", "left_semi").select("id", "doc", "mark", "n_shingles", "signature").checkpoint()
    links = linked_classes(heads, texts_of(docs, id_column, text_column), words, percent)
    odd = not one.where("id != doc").isEmpty()
    if odd and one_per_id:
        own = members.join(several, "doc", "left_semi").select("doc", "class").distinct().checkpoint()
        least = own.groupBy("doc").agg(F.min("class").alias("a"))
        links = links.union(own.join(least, "doc").where("a < class").select("a", F.col("class").alias("b"))).checkpoint()
    found = connected_components(links)
    per_class = members.join(found.withColumnRenamed("node", "class"), "class", "left").select("id", F.coalesce("component", "class").alias("component"))
    result = one.select("id", "doc", "mark", "n_shingles").join(per_class, "id", "left").select("id", "doc", "mark", "n_shingles", F.coalesce("component", "id").alias("component"))
    if not odd:
        return result.select("doc", "mark", "n_shingles", "component", (F.col("id") == F.col("component")).alias("kept"))
    # Components with hashed numbers get the smallest id that they have.
    result = result.checkpoint()
    shown = result.where((F.col("id") == F.col("doc")) | (F.col("doc") == NO_ID)) if one_per_id else result
    of = result.where("id != doc").select("component").distinct()
    best = F.min(F.struct((F.col("doc") == NO_ID).alias("none"), "doc", "mark"))
    named_by = shown.join(of, "component", "left_semi").groupBy("component").agg(best.alias("head")).checkpoint()
    kept = F.when(F.col("head").isNull(), F.col("id") == F.col("component")).otherwise((F.col("doc") == F.col("head.doc")) & (F.col("mark") == F.col("head.mark")))
    return shown.join(named_by, "component", "left").select("doc", "mark", "n_shingles", F.coalesce("head.doc", "component").alias("component"), kept.alias("kept"))


def linked_classes(heads: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links ``a, b`` between classes, enough of them to join all that are linked at all."""
    # Dealt out by key once, for both the counts and the join.
    keys = chunk_keys(heads).repartition("key")
    shared = keys.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("key", "least")
    # Only buckets of two classes or more go on.
    buckets = keys.join(shared, "key").select("key", "id", "least").checkpoint()
    texts = texts.withColumnRenamed("id", "doc")

    # One comparison for each class to begin with: that with the smallest class it may be near.
    side = lambda name: heads.select(F.col("id").alias(name), F.col("signature").alias(f"{name}_signature"), F.col("n_shingles").alias(f"{name}_n"))
    near = (signature_distance(F.col("a_signature"), F.col("b_signature")) <= DISTANCE) & (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
    stars = buckets.where("least < id").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    nearest = stars.join(side("a"), "a").join(side("b"), "b").where(near).groupBy("b").agg(F.min("a").alias("a")).select("a", "b").checkpoint()
    links = confirmed(nearest, heads, texts, words, percent).checkpoint()

    # Buckets that still hold several components.
    found = connected_components(links).withColumnRenamed("node", "id").checkpoint()
    placed = buckets.select("key", "id").join(found, "id", "left").select(F.col("key").alias("family"), "id", F.coalesce("component", "id").alias("component"))
    rest = several(placed).checkpoint()
    if rest.isEmpty():
        return links
    parts = rest.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    crowded = parts.groupBy("family").agg((F.sum("n") - F.max("n")).alias("beside")).where(F.col("beside") > CROWD).select("family").checkpoint()
    if not crowded.isEmpty():
        rest = rest.join(crowded, "family", "left_anti").unionByName(second_level(rest.join(crowded, "family", "left_semi"), heads)).checkpoint()
    # Their classes that may be near over components form families, within which the texts decide.
    candidates = compared(rest, lambda cells: cells.join(heads.select("id", "n_shingles", "signature"), "id"), BLOCK_ROWS, lambda columns, apart: plausible(columns, apart, percent)).checkpoint()
    families = connected_components(candidates).select(F.col("component").alias("family"), F.col("node").alias("id"))
    members = families.join(found, "id", "left").select("family", "id", F.coalesce("component", "id").alias("component")).checkpoint()
    named = heads.select("id", "doc", "mark").join(members, "id", "left_semi").checkpoint()
    late = compared(members, lambda cells: with_texts(cells, named, texts), 256, lambda columns, apart: similar(columns, apart, words, percent))
    return links.union(late).checkpoint()


def cells(rows: DataFrame, size: int) -> DataFrame:
    """Deals out ``family, id, component`` so that any two rows of a family in different components meet in one cell.

    Large components get blocks of their own, small ones share blocks, of about ``size`` rows; a cell takes two blocks, or
    one shared block by itself. Two blocks of one component never meet. Result: ``family, x, y, side, id, component``.
    """
    # Written, so that the rows of a large component can be split where they are joined to its count.
    counts = rows.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    pool = F.when(F.col("n") > size, F.col("component"))
    pools = counts.groupBy("family", pool.alias("pool")).agg(F.ceil(F.sum("n") / F.lit(size)).cast("int").alias("parts"))
    named = F.concat_ws(".", F.coalesce(F.col("pool").cast("string"), F.lit("s")), F.col("part"))
    blocks = pools.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("family", "pool", named.alias("block"))
    left, right = blocks.select("family", F.col("pool").alias("p"), F.col("block").alias("x")), blocks.select("family", F.col("pool").alias("q"), F.col("block").alias("y"))
    pairs = left.join(right, "family").where("x <= y AND NOT coalesce(p = q, false)").select("family", "x", "y")
    ends = pairs.select("family", "x", "y", F.col("x").alias("block"), F.lit(0).alias("side")).union(pairs.where("x < y").select("family", "x", "y", F.col("y").alias("block"), F.lit(1).alias("side")))
    own = rows.join(counts.select("family", "component", pool.alias("pool")), ["family", "component"]).withColumn("_pool", F.coalesce(F.col("pool").cast("string"), F.lit("s")))
    parts = pools.select("family", F.coalesce(F.col("pool").cast("string"), F.lit("s")).alias("_pool"), "parts")
    # Classes of one small component go to one block.
    spread = F.when(F.col("pool").isNull(), F.xxhash64("component")).otherwise(F.xxhash64("id"))
    dealt = own.join(parts, ["family", "_pool"]).select("family", "id", "component", F.concat_ws(".", "_pool", F.pmod(spread, F.col("parts")).cast("int").cast("string")).alias("block"))
    return dealt.join(ends, ["family", "block"]).select("family", "x", "y", "side", "id", "component")


def compared(rows: DataFrame, known: Callable[[DataFrame], DataFrame], size: int, partners) -> DataFrame:
    """Pairs ``a, b`` that join what ``partners`` finds near inside the cells of ``rows``; ``known`` adds what is compared.

    ``partners`` gets the columns of a cell and a matrix of the pairs to look at, and returns a matrix of those that are
    near. Only a spanning forest of them is returned, so a cell never gives more pairs than it has rows.
    """
    stream = known(cells(rows, size)).repartition("family", "x", "y").sortWithinPartitions("family", "x", "y", "side")
    names = [c for c in stream.columns if c not in ("family", "x", "y", "side", "id", "component")]
    stream = stream.select("family", "x", "y", "side", "id", "component", *names)

    def forest(held: list[pa.RecordBatch]) -> tuple[list[int], list[int]]:
        cell = pa.Table.from_batches(held).combine_chunks()
        ids, components, sides = (cell[c].to_numpy() for c in ("id", "component", "side"))
        apart = components[:, None] != components[None, :]
        if sides.any():
            apart &= sides[:, None] != sides[None, :]
        left, right = [], []
        if not apart.any():
            return left, right
        near = partners({c: cell[c] for c in names}, apart)
        seen = np.zeros(len(ids), bool)
        for root in range(len(ids)):
            todo = [] if seen[root] else [root]
            seen[root] = True
            while todo:
                u = todo.pop()
                more = np.flatnonzero(near[u] & ~seen)
                seen[more] = True
                todo += more.tolist()
                left += [min(ids[u], ids[v]) for v in more]
                right += [max(ids[u], ids[v]) for v in more]
        return left, right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            starts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
            left, right = [], []
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                if held and keys[a] != last:
                    found = forest(held)
                    left += found[0]
                    right += found[1]
                    held = []
                held.append(batch.slice(a, b - a))
                last = keys[a]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])
        if held:
            left, right = forest(held)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])
        give_back()

    return stream.mapInArrow(run, "a bigint, b bigint")


def plausible(columns: dict, apart: np.ndarray, percent: int) -> np.ndarray:
    """Pairs whose signatures are within DISTANCE and whose sizes allow the similarity."""
    signs = np.frombuffer(b"".join(columns["signature"].to_pylist()), np.uint16).reshape(-1, POSITIONS)
    sizes = columns["n_shingles"].to_numpy()
    differ = np.zeros(apart.shape, np.uint8)
    for k in range(POSITIONS):
        differ += signs[:, k][:, None] != signs[:, k][None, :]
    return apart & (differ <= DISTANCE) & (100 * np.minimum(sizes[:, None], sizes[None, :]) >= percent * np.maximum(sizes[:, None], sizes[None, :]))


def similar(columns: dict, apart: np.ndarray, words: int, percent: int) -> np.ndarray:
    """Pairs whose full sets are similar enough; common shingles are counted by their postings."""
    sets = list(shingle_sets(columns["text"].combine_chunks(), words))
    sizes = np.array([len(s) for s in sets], np.int64)
    who = np.repeat(np.arange(len(sets)), sizes)
    codes, place = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(place, kind="stable")
    postings, bounds = who[order], np.searchsorted(place[order], np.arange(len(codes) + 1))
    near, ends = np.zeros(apart.shape, bool), row_ends(sizes)
    for i in np.flatnonzero(apart.any(axis=1)):
        mine = place[ends[i] : ends[i + 1]]
        common = np.bincount(postings[ragged(bounds[mine], bounds[mine + 1] - bounds[mine])], minlength=len(sets))
        near[i] = apart[i] & (100 * common >= percent * (sizes[i] + sizes - common))
    return near
