"""Bloom filters of a small table's keys, to leave out rows of a large one before they are shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter, and places that each key takes in it; with a quarter of a million keys, two of a hundred others pass too.
BITS, PLACES = 1 << 22, 4


def _places(keys: Sequence[Column], bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(k), *keys), F.lit(bits)) for k in range(PLACES)]


def bloom_filter(df: DataFrame, keys: Sequence[str], bits: int = BITS) -> Column:
    """The filter of the rows' keys as one value, an array of 64-bit words, which the query that uses it computes.

    Its size is fixed by ``bits``, whatever the table; with many more keys than it has room for, it lets all rows pass.
    Rows with a NULL key are not in it.
    """
    there = df
    for k in keys:
        there = there.where(F.col(k).isNotNull())
    place = there.select(F.explode(F.array(*_places([F.col(k) for k in keys], bits))).alias("place"))
    # a bit of a 64-bit word by its number; the literal table spares a shift by a column
    bit = F.element_at(F.array(*[F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b) for b in range(64)]), (F.col("place").bitwiseAND(F.lit(63)) + 1).cast("int"))
    words = place.select(F.shiftright("place", 6).alias("word"), bit.alias("bits"))
    every = df.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    dense = words.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"])).scalar()


def may_hold(words: Column, keys: Sequence[Column], bits: int = BITS) -> Column:
    """Whether a filter may hold the keys; false only if it does not."""
    held = F.lit(True)
    for place in _places(keys, bits):
        word = F.get(words, F.shiftright(place, 6).cast("int"))
        held = held & (F.getbit(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return held
