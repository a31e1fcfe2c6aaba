"""Operators that keep state of their own per key: votes of a gate, the silence of an alert, the sample of a period, rows
behind the watermark.
"""

from __future__ import annotations

import json
import time
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.types import BooleanType, StructField, StructType

from modelward.operators.approvals import GATE_DECISIONS
from modelward.session import ship_package

#: Groups that gates are dealt out over, for a stream of a few million gates. State keeps for good the number it starts with.
GATE_SLOTS = 4096
#: How a closed gate is held.
CLOSED = 0
#: Voters that are kept with a gate itself; more are kept one by one.
FEW = 64
_GATE_ROWS = "approval_id string, required_count int, status string, approved_count bigint, rejected_count bigint, responses bigint, closed_at bigint"
_GATE_COLUMNS = [c.split()[0] for c in _GATE_ROWS.split(", ")]
#: Columns of a vote, in the order that votes count in; no id comes before any.
_VOTE = ["approval_id", "at", "has_id", "event_id", "decision", "voter", "required_count"]


class GateVotes(StatefulProcessor):
    """State of the gates of one slot: how each stands, and while it is open, who has voted.

    The slot's gates are one value, a JSON object by gate, which is read and written once a batch: a call to the store costs
    far more than the votes of a gate. An open gate is its counts and its few voters, or null for those of a large gate, which
    are entries of a map, of which a batch touches only its own. Of a closed gate only the id is kept.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.gates = handle.getValueState("gates", "gates string")
        self.voted = handle.getMapState("voted", "approval_id string, voter string", "decision string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.gates.get()
        gates = json.loads(before[0]) if before else {}
        votes = sorted(v for frame in rows for v in zip(*(frame[c].tolist() for c in _VOTE)))
        changed = []
        for gate, mine in groupby(votes, key=itemgetter(0)):
            held = gates.get(gate, (0, 0, 0, ()))
            # a closed gate stays closed, whatever a later batch brings
            if held != CLOSED and (row := self.counted(gates, gate, held, mine)):
                changed.append(row)
        if changed:
            self.gates.update((json.dumps(gates, separators=(",", ":")),))
            yield pd.DataFrame(dict(zip(_GATE_COLUMNS, (pd.Series(c, dtype=object) for c in zip(*changed)))))

    def counted(self, gates: dict, gate: str, held, votes: Iterator[tuple]) -> tuple | None:
        """Counts the votes of a batch, in their order, for an open gate; its row, if any of them is new."""
        approved, rejected, responses, few = held
        many, known, required, fresh = few is None, set(few or ()), 1, {}
        status, closed = "pending", None
        for _, at, has_id, event_id, decision, voter, required in votes:
            if status != "pending" and (at, has_id, event_id) != closed:
                break
            if voter in fresh or voter in known or (many and self.voted.containsKey((gate, voter))):
                continue
            fresh[voter] = decision
            responses += 1
            approved += decision == "approve"
            rejected += decision == "reject"
            if status == "pending" and (decision == "reject" or (decision == "approve" and approved >= required)):
                status, closed = ("rejected" if decision == "reject" else "approved"), (at, has_id, event_id)
        if not fresh:
            return None
        if status != "pending":
            gates[gate] = CLOSED
            if many:
                for voter in [v for g, v in self.voted.keys() if g == gate]:
                    self.voted.removeKey((gate, voter))
        elif many or len(known) + len(fresh) > FEW:
            for voter in [*(few or ()), *fresh]:
                self.voted.updateValue((gate, voter), (fresh.get(voter),))
            gates[gate] = (approved, rejected, responses, None)
        else:
            gates[gate] = (approved, rejected, responses, [*few, *fresh])
        return gate, required, status, approved, rejected, responses, closed and closed[0]

    def close(self) -> None:
        pass


def gate_votes(votes: DataFrame, gates: DataFrame, slots: int = GATE_SLOTS) -> DataFrame:
    """The state of each gate after every batch that changed it: a voter counts once, and votes after the close don't.

    ``votes``: approval_id, voter, event_time, event_id, decision; ``gates``: approval_id, required_count, as a table. Votes
    of a batch count in event order. Gates are dealt out over ``slots`` by a hash of their id, and a batch reads only the
    slots that it touches, once each; a thousand gates or so to a slot make the calls to the store few and its values small.
    Voters are forgotten when the gate closes. Votes without a voter, of unknown gates, or with another decision never count.
    """
    ship_package(votes.sparkSession)
    kind = votes.schema["event_time"].dataType
    need = F.greatest(F.coalesce("required_count", F.lit(1)), F.lit(1)).cast("int").alias("required_count")
    at = F.unix_micros(F.col("event_time").cast("timestamp")).alias("at")
    ok = votes.where(F.col("decision").isin(*GATE_DECISIONS) & F.col("voter").isNotNull() & F.col("event_time").isNotNull())
    rows = ok.select(F.col("approval_id").cast("string").alias("approval_id"), "voter", at, F.col("event_id").isNotNull().alias("has_id"), F.coalesce(F.col("event_id").cast("long"), F.lit(0)).alias("event_id"), "decision")
    known = rows.join(gates.select(F.col("approval_id").cast("string").alias("approval_id"), need), "approval_id")
    dealt = known.withColumn("slot", F.pmod(F.xxhash64("approval_id"), F.lit(slots)))
    states = dealt.groupBy("slot").transformWithStateInPandas(GateVotes(), _GATE_ROWS, "Update", "None")
    return states.withColumn("completed_timestamp", F.timestamp_micros("closed_at").cast(kind)).drop("closed_at")


class Silence(StatefulProcessor):
    """State of one alert: when it last fired; forgotten once the watermark has passed its silence."""

    def __init__(self, micros: int) -> None:
        self.micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "fired bigint, timer bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        times = sorted(r.at for r in rows)
        fired, timer = self.last.get() or (None, None)
        at = 0 if fired is None else bisect_left(times, fired + self.micros)
        was = fired
        while at < len(times):
            fired = times[at]
            yield Row(key=key[0], at=fired)
            at = bisect_left(times, fired + self.micros, at)
        if fired != was:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = (fired + self.micros) // 1000 + 1
            self.handle.registerTimer(timer)
            self.last.update((fired, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def firings(stream: DataFrame, key: str, ts: str, silence_seconds: int, delay: str) -> DataFrame:
    """``key, ts`` of the events that fire: the first of a key, then each that comes ``silence_seconds`` or more after the
    last that fired.

    Events of a batch are taken in time order, whatever calendar day they fall in. An event that comes late but ahead of the
    watermark fires only if it is that long after the last firing. Rows without a key or time never fire.
    """
    ship_package(stream.sparkSession)
    kind = stream.schema[ts].dataType
    watched = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    rows = watched.select(F.col(key).alias("key"), F.col(ts).alias("_ts"), F.unix_micros(ts).alias("at"))
    out = f"key {stream.schema[key].dataType.simpleString()}, at bigint"
    fired = rows.groupBy("key").transformWithState(Silence(silence_seconds * 1_000_000), out, "Append", "EventTime")
    return fired.select(F.col("key").alias(key), F.timestamp_micros("at").cast(kind).alias(ts))


class PeriodSample(StatefulProcessor):
    """State of one period: the rows drawn so far; they are given out when the watermark has passed its end."""

    def __init__(self, size: int, width: int, key_type: str) -> None:
        self.size, self.width, self.key_type = size, width, key_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.drawn = handle.getValueState("drawn", f"draws array<string>, ids array<{self.key_type}>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.drawn.get()
        fresh = {(r.draw, r.id) for r in rows if r.draw is not None}
        if fresh:
            if held is None:
                self.handle.registerTimer((key[0] + self.width) // 1000)
            best = sorted({*fresh, *(zip(*held) if held else ())})[: self.size]
            self.drawn.update(([d for d, _ in best], [i for _, i in best]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, ids = self.drawn.get()
        self.drawn.clear()
        for i in ids:
            yield Row(period=key[0], id=i)

    def close(self) -> None:
        pass


def period_samples(stream: DataFrame, key: str, ts: str, seconds: int, size: int, delay: str) -> DataFrame:
    """``period, key``: of each period, the ``size`` ids that come first by a hash, once the watermark has passed its end.

    Each task cuts what it has read to ``size`` rows per period before they are shuffled, so a busy period sends few rows to
    its state. Rows behind the watermark, and those without an id or time, are never drawn; an id counts once.
    """
    ship_package(stream.sparkSession)
    kind, width = stream.schema[key].dataType.simpleString(), seconds * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select((F.floor(at / width) * width).cast("long").alias("period"), F.md5(F.col(key).cast("string")).alias("draw"), F.col(key).alias("id"), at.alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, set] = {}
        last, schema = None, None
        for batch in batches:
            schema = batch.schema
            for period, draw, i, when in zip(*(c.to_pylist() for c in batch.columns)):
                mine = best.setdefault(period, set())
                mine.add((draw, i, when))
                if len(mine) > 4 * size + 64:
                    best[period] = set(sorted(mine)[:size])
                last = when if last is None else max(last, when)
        if last is not None:
            found = [(p, *row) for p, mine in best.items() for row in sorted(mine)[:size]]
            # the latest time read moves the watermark, whether or not its row is drawn
            found.append((last // width * width, None, None, last))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    few = rows.mapInArrow(cut, f"period bigint, draw string, id {kind}, at bigint").withColumn("_ts", F.timestamp_micros("at")).withWatermark("_ts", delay)
    drawn = few.groupBy("period").transformWithState(PeriodSample(size, width, kind), f"period bigint, id {kind}", "Append", "EventTime")
    return drawn.select(F.timestamp_micros("period").alias("period"), F.col("id").alias(key))


def with_lateness(stream: DataFrame, ts: str, delay: str, slots: int = 64) -> DataFrame:
    """All rows, with ``late`` true for those behind the watermark when they came: the largest time of earlier batches less
    the delay.

    Spark's own time windows drop such rows; here they go on, so that a sink can keep them apart. Rows are dealt out by their
    hash over ``slots`` groups, so no key weighs on one task. A row without a time is late.
    """
    ship_package(stream.sparkSession)
    columns = [f"`{c}`" for c in stream.columns]
    kept = StructType([StructField("row", stream.schema), StructField("late", BooleanType())])
    marked = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    rows = marked.select(F.pmod(F.xxhash64(*columns), F.lit(slots)).alias("slot"), "_ts", F.unix_micros("_ts").alias("at"), F.struct(*columns).alias("row"))

    def split(key, frames, state):
        behind = state.getCurrentWatermarkMs() * 1000
        for frame in frames:
            yield frame[["row"]].assign(late=frame["at"].isna() | (frame["at"] < behind))

    return rows.groupBy("slot").applyInPandasWithState(split, kept, "n int", "append", "NoTimeout").select("row.*", "late")


class LateRows(StreamingQueryListener):
    """Counts the late rows of streams by query and batch, so that a repeated batch counts once."""

    def __init__(self) -> None:
        self.batches: dict[tuple[str, int], int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get("lateness")
        if seen is not None:
            self.batches[str(event.progress.id), event.progress.batchId] = seen.late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def total(self, query_id: str) -> int:
        return sum(n for (of, _), n in self.batches.items() if of == query_id)

    def settled(self, query_id: str, last_batch: int, seconds: float = 10.0) -> int:
        """The total of a query that has ended, once the report of its last batch has come."""
        end = time.monotonic() + seconds
        while last_batch >= 0 and (query_id, last_batch) not in self.batches and time.monotonic() < end:
            time.sleep(0.05)
        return self.total(query_id)


def start_split(stream: DataFrame, folder: str, once: bool = False):
    """Start writing rows of `with_lateness` below ``folder``, those in time and those late in folders of their own.

    The number of late rows is an observed metric of every batch, for a listener to count.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("late").parquet(f"{folder}/data/batch_id={batch_id}")

    counted = stream.observe("lateness", F.count_if("late").alias("late"), F.count(F.lit(1)).alias("rows"))
    writer = counted.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()
