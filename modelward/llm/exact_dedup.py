"""Exact duplicates: groups of equal normalised texts, found by a 128-bit hash and confirmed on their bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the white space that the comparison ignores.
WHITE_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def squeezed(text: Column) -> Column:
    """The text without white space; null reads as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def content_hash(text: Column) -> Column:
    """128 bits of the text."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Rows are grouped by ``hashed`` of the squeezed text and, inside a hash, by the text's bytes, so that texts with one
    hash stay apart. Copies shrink to one row per task before the only shuffle of texts; what is joined back to the rows
    carries no texts. The row with the most code points stays, then the smallest id.

    Ids may be of any type that has an order, texts of any length. Null text counts as empty, and empty texts are equal to each other. A null id takes part in its group but is never
    the one that stays unless the whole group has none. Rows repeated with one id are counted each; ``kept`` is true for
    all rows with the id that stays. Other columns are not read; an empty table gives no rows.
    """
    text = F.col("_text")
    rows = docs.select(F.col(id_column).alias("doc_id"), squeezed(F.col(text_column)).alias("_text"), F.char_length(F.coalesce(F.col(text_column), F.lit(""))).cast("long").alias("_points"))
    rows = rows.select("doc_id", "_text", "_points", hashed(text).alias("_hash"))
    # The text itself is a grouping key: this is the comparison of bytes inside a hash. Lengths and ids are plain numbers,
    # so this stays a hash aggregate.
    variants = rows.groupBy("_hash", "_text", "_points").agg(F.count(F.lit(1)).alias("_rows"), F.min("doc_id").alias("_least"))
    variants = variants.select("_hash", F.sha2(text.cast("binary"), 256).alias("_sha"), "_points", "_rows", "_least")
    preference = F.struct(F.col("_least").isNull().alias("none"), (-F.col("_points")).alias("points"), F.col("_least").alias("order"))
    groups = variants.groupBy("_hash", "_sha").agg(F.sum("_rows").alias("group_size"), F.min_by("_least", preference).alias("keep_id"))
    # Equal texts have one digest. Both sides are shuffled for this join alone, so Spark can split the rows of a large group.
    light = rows.select("doc_id", F.sha2(text.cast("binary"), 256).alias("_sha"))
    joined = light.join(groups.drop("_hash"), "_sha")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256"))
