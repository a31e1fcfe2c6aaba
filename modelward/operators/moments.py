"""Means, variances and correlations of many columns in one pass: matrices of moments, merged over tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelward.session import ship_package

#: Groups in which the matrices of the tasks are merged before the last merge.
GROUPS = 64
#: A variance below this share of the squares about the block's mean counts as none.
NOISE = 1e-14
_PARTS = ("n", "mean", "square", "cross", "odd")


@dataclass
class Moments:
    """Square matrices over the columns; entry (i, j) goes over the rows in which both i and j have a value.

    ``n`` counts them, ``mean`` and ``square`` are the mean and the squared deviations of i, ``cross`` are the products of
    the deviations of i and j, ``odd`` counts the rows in which one of them is not finite.
    """

    n: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    cross: np.ndarray
    odd: np.ndarray

    @classmethod
    def empty(cls, width: int) -> Moments:
        return cls(*(np.zeros((width, width)) for _ in _PARTS))

    @classmethod
    def of(cls, x: np.ndarray, there: np.ndarray) -> Moments:
        """Of one block of rows; ``there`` marks the values that are not NULL."""
        finite = np.isfinite(x) & there
        m = finite.astype(float)
        # deviations from the block's own means, so that large means cost no digits; of one value they are 0
        least, most = np.where(finite, x, np.inf).min(axis=0), np.where(finite, x, -np.inf).max(axis=0)
        centre = np.where(least == most, least, np.where(finite, x, 0.0).sum(axis=0) / np.maximum(m.sum(axis=0), 1))
        d = np.where(finite, x - centre, 0.0)
        n = m.T @ m
        part = np.maximum(n, 1)
        shift = (d.T @ m) / part
        raw = (d * d).T @ m
        square = raw - shift**2 * n
        cross = d.T @ d - shift * shift.T * n
        both = there.astype(float)
        # what is left of equal values is rounding
        return cls(n, centre[:, None] + shift, np.where(square > NOISE * raw, square, 0.0), cross, both.T @ both - n)

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        share = other.n / np.maximum(n, 1)
        gap = np.where(self.n == 0, 0.0, np.where(other.n == 0, 0.0, other.mean - self.mean))
        weight = self.n * share
        mean = np.where(self.n == 0, other.mean, self.mean + gap * share)
        return Moments(n, mean, self.square + other.square + gap**2 * weight, self.cross + other.cross + gap * gap.T * weight, self.odd + other.odd)

    def correlation(self) -> np.ndarray:
        """Pearson correlations; NaN where a value is not finite, and where a column does not vary."""
        with np.errstate(invalid="ignore", divide="ignore"):
            out = self.cross / np.sqrt(self.square * self.square.T)
        return np.where((self.odd > 0) | (self.square <= 0) | (self.square.T <= 0), np.nan, out)

    def batch(self, slot: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), *(pa.array([getattr(self, p).tobytes()], pa.binary()) for p in _PARTS)], ["slot", *_PARTS])


def _merge(width: int):
    """A task's worth of stored matrices as one; rows are taken one by one."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for i in range(batch.num_rows):
                one = Moments(*(np.frombuffer(batch.column(p)[i].as_buffer()).reshape(width, width) for p in _PARTS))
                total = one if total is None else total.merged(one)
        if total is not None:
            yield total.batch(0)

    return merge


def moment_matrix(df: DataFrame, columns: Sequence[str], groups: int = GROUPS) -> DataFrame:
    """One row with the moments of all pairs of columns, as `Moments` keeps them; the table is read once.

    Each task returns one matrix. These are merged in ``groups`` tasks and then in one, which sees one matrix of each group.
    """
    width = len(columns)
    schema = "slot int, " + ", ".join(f"{p} binary" for p in _PARTS)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Moments.empty(width)
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([pc.fill_null(c, 0.0).to_numpy(zero_copy_only=False) for c in batch.columns])
                there = np.column_stack([pc.is_valid(c).to_numpy(zero_copy_only=False) for c in batch.columns])
                total = total.merged(Moments.of(x, there))
        yield total.batch(TaskContext.get().partitionId() % groups)

    ship_package(df.sparkSession)
    parts = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(moments, schema)
    return parts.repartition(groups, "slot").mapInArrow(_merge(width), schema).repartition(1).mapInArrow(_merge(width), schema)


def pair_rows(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``field, other_field, n, correlation`` of every pair of columns, NULL where `F.corr` has NULL."""
    width, names = len(columns), list(columns)
    a, b = np.triu_indices(width, 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                m = Moments(*(np.frombuffer(batch.column(p)[i].as_buffer()).reshape(width, width) for p in _PARTS))
                n, odd = m.n[a, b].astype(np.int64), m.odd[a, b].astype(np.int64)
                flat = (odd == 0) & ((m.square[a, b] <= 0) | (m.square[b, a] <= 0))
                r = pa.array(m.correlation()[a, b], mask=flat)
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in a]), pa.array([names[k] for k in b]), pa.array(n + odd), r], ["field", "other_field", "n", "correlation"])

    return matrix.mapInArrow(rows, "field string, other_field string, n bigint, correlation double")
