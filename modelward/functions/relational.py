"""Relational building blocks whose work stays spread out when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key.

    Filtering on ``row_number`` lets Spark cut every map task to ``k`` rows per key before the shuffle, so a hot key
    ships only ``k`` rows per task.
    """
    pos = rank or "_pos"
    out = df.withColumn(pos, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(pos) <= k)
    return out if rank else out.drop(pos)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join where NULL keys meet each other; key columns come from the left."""
    marked = right.select([F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(marked, cond, how).drop(*[f"_r_{k}" for k in keys])


def numeric_columns(df: DataFrame, among: Sequence[str] | None = None) -> list[str]:
    kinds = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return [
        f.name
        for f in df.schema.fields
        if (f.dataType.simpleString() in kinds or f.dataType.simpleString().startswith("decimal"))
        and (among is None or f.name in among)
    ]


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), as_type: str = "string") -> DataFrame:
    """One row per (row, column): ``keep`` columns, ``field`` and ``value``. Narrow, so an aggregate fuses with it."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast(as_type).alias("value")) for c in columns])
    return df.select(*keep, F.explode(cells).alias("_cell")).select(*keep, "_cell.field", "_cell.value")


def wide_to_rows(df: DataFrame, entries: Sequence[tuple[str, dict[str, Column]]], keep: Sequence[str] = (), name: str = "field") -> DataFrame:
    """Turn a wide aggregate into rows: one entry per output row, each with the same set of columns."""
    cells = F.array(*[F.struct(F.lit(label).alias(name), *[c.alias(n) for n, c in cols.items()]) for label, cols in entries])
    return df.select(*keep, F.explode(cells).alias("_cell")).select(*keep, "_cell.*")
