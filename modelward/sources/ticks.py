"""A stream of numbered rows that become due with time: first a seed, then a few with each tick."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from modelward.session import ship_package

# Rows of the seed and of a tick.
SEED, TICK = 500, 25
#: Row numbers that one task makes.
RANGE = 100_000


class Rows(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class TickReader(DataSourceStreamReader):
    """Offsets count rows. What is due follows from the clock and the options alone, so a restart goes on where it was."""

    def __init__(self, options: dict[str, str]) -> None:
        self.rows, self.seed, self.tick = (int(options[k]) for k in ("rows", "seed", "tick"))
        self.every, self.since = float(options["every"]), float(options["since"])

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        ticks = max(0, int((time.time() - self.since) / self.every))
        return {"row": min(self.rows, self.seed + ticks * self.tick)}

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        return [Rows(a, min(a + RANGE, end["row"])) for a in range(start["row"], end["row"], RANGE)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        for row in range(partition.first, partition.last):
            yield row, 0 if row < self.seed else 1 + (row - self.seed) // self.tick

    def commit(self, end: dict) -> None:
        pass


class Ticks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "modelward_ticks"

    def schema(self) -> str:
        return "row bigint, tick bigint"

    def streamReader(self, schema) -> TickReader:
        return TickReader(self.options)


def ticks(spark: SparkSession, rows: int, since: float, every: float = 1.0, seed: int = SEED, tick: int = TICK) -> DataFrame:
    """A stream of ``row, tick``: numbers from 0 to ``rows``, the first ``seed`` at once and ``tick`` more every so many seconds
    after ``since`` (seconds of the epoch).

    Rows are numbers only; a join with a table gives them their contents. Two runs of a query that keep ``since`` read the
    same rows, whatever batches they come in.
    """
    ship_package(spark)
    spark.dataSource.register(Ticks)
    options = {"rows": rows, "seed": seed, "tick": tick, "every": every, "since": since}
    return spark.readStream.format("modelward_ticks").options(**options).load()


def replayed(table: DataFrame, key: str, since: float, every: float = 1.0, seed: int = SEED, tick: int = TICK) -> DataFrame:
    """A table as a stream in the order of ``key``, a column of whole numbers from 0: rows come as their numbers fall due."""
    last = table.agg({key: "max"}).first()[0]
    numbers = ticks(table.sparkSession, 0 if last is None else last + 1, since, every, seed, tick)
    return numbers.join(table, numbers.row == table[key]).drop("row")
