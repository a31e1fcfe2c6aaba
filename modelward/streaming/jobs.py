"""Structured Streaming forms of the operators.

Windowed results are written in update mode, one folder per micro-batch, and read back folded to the last value per key:
a repeated batch overwrites its own folder, so each batch counts once.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from modelward.functions.columns import count_where, days_between, ratio, share
from modelward.functions.identifiers import check_table
from modelward.session import fresh_folder


def stream_session(spark: SparkSession, state_partitions: int | None = None, on_disk: bool = True) -> SparkSession:
    """A session for streams beside the given one: its settings, the number of state partitions, and where state is held.

    A stream's state keeps for good the number of partitions it starts with, so that belongs to the stream's own session. State
    on disk has room for any number of keys, and operators with state of their own need it; else it is held in memory.
    """
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if own.conf.isModifiable(name):
            own.conf.set(name, value)
    if on_disk:
        own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    if state_partitions:
        own.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    return own


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a path names one file and not a folder, in any store that Spark reads; an unknown one is refused."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not store.exists(place):
        raise FileNotFoundError(path)
    return store.getFileStatus(place).isFile()


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = None, form: str = "parquet", **options: str) -> DataFrame:
    """An append-only file, or folder of files, as a stream; a missing source fails here and not after the start."""
    one = is_file(spark, path)
    reader = spark.readStream.format(form).options(**options).schema(spark.read.format(form).options(**options).load(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if one:
        # streams read folders or patterns; signs of a pattern in the name stand for themselves
        path = re.sub(r"([*?\[\]{}\\])", r"\\\1", path[:-1]) + f"[{path[-1]}]"
    return reader.load(path)


def read_stream_table(spark: SparkSession, name: str) -> DataFrame:
    """A table of the catalog as a stream of the rows appended to it."""
    return spark.readStream.table(check_table(name))


def _start(writer, once: bool):
    return (writer.trigger(availableNow=True) if once else writer).start()


def start(stream: DataFrame, folder: str, mode: str = "append", once: bool = False):
    """Start writing a stream's batches below ``folder``; ``once`` stops when the source is read."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/data/batch_id={batch_id}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
    return _start(writer, once)


def results(spark: SparkSession, folder: str, schema, keys: Sequence[str] = ()) -> DataFrame:
    """What a stream has written; with ``keys``, the last state of each key."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch_id", LongType())])).parquet(f"{folder}/data")
    if not keys:
        return rows.drop("batch_id")
    value = [c for c in rows.columns if c not in keys and c != "batch_id"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*value), "batch_id").alias("_v")).select(*keys, "_v.*")


def drain(stream: DataFrame, mode: str = "append", keys: Sequence[str] = (), folder: str | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Run a stream over all that is there and return its results, in the given session or the stream's."""
    spark = spark or stream.sparkSession
    folder = folder or fresh_folder(spark, "streams")
    query = start(stream, folder, mode, True)
    query.awaitTermination()
    if query.lastProgress is None:  # the source held nothing
        return spark.createDataFrame([], stream.schema)
    return results(spark, folder, stream.schema, keys)


def late_rows(query) -> int:
    """Rows that the watermark made a stream drop so far; the batch pass picks them up."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])


def score_stream(stream: DataFrame, model: Column, out: str = "prediction") -> DataFrame:
    """Score every row with a model written as an expression; ``feedback.score`` serves models in Python."""
    return stream.withColumn(out, model)


def once_per_id(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Take each id once among rows that arrive within the delay of each other."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def once_per_period(stream: DataFrame, key: str, ts: str, period: str, delay: str) -> DataFrame:
    """One event per key and period: repeats of an alert inside a period are dropped."""
    tagged = stream.withWatermark(ts, delay).withColumn("period_start", F.window(ts, period)["start"])
    return tagged.dropDuplicatesWithinWatermark([key, "period_start"])


def metric_windows(stream: DataFrame, ts: str, size: str, key: str, value: str, is_error: str, delay: str) -> DataFrame:
    """Count, mean, largest value and error rate per key and tumbling window."""
    w = F.window(ts, size)
    return (
        stream.withWatermark(ts, delay)
        .groupBy(w.alias("_w"), key)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"), F.max(value).alias("max_value"), share(F.col(is_error)).alias("error_rate"))
        .select(F.col("_w.start").alias("window_start"), key, "n", "mean_value", "max_value", "error_rate")
    )


def rollback_triggers(stream: DataFrame, ts: str, key: str, is_error: str, delay: str, *, size: str = "5 minutes", slide: str = "1 minute", max_errors: int = 10, max_rate: float = 0.1) -> DataFrame:
    """Windows in which a model's errors reach the count or pass the rate."""
    counted = stream.withWatermark(ts, delay).groupBy(F.window(ts, size, slide).alias("_w"), key).agg(F.count(F.lit(1)).alias("n"), count_where(F.col(is_error)).alias("errors"))
    return counted.where((F.col("errors") >= max_errors) | (ratio(F.col("errors"), F.col("n")) > max_rate)).select(F.col("_w.start").alias("window_start"), key, "n", "errors")


def feedback_stream(predictions: DataFrame, labels: DataFrame, *, latency: str, prediction_delay: str, label_delay: str) -> DataFrame:
    """Predictions joined to labels that arrive within the latency; both sides forget rows past it.

    ``predictions``: prediction_id, predicted_at, predicted_value. ``labels``: label_id, arrived_at, actual_label.
    """
    p = predictions.withWatermark("predicted_at", prediction_delay)
    lab = labels.withWatermark("arrived_at", label_delay)
    near = F.expr(f"label_id = prediction_id AND arrived_at >= predicted_at AND arrived_at <= predicted_at + INTERVAL {latency}")
    return p.join(lab, near).select(
        "prediction_id", "predicted_value", "actual_label", "predicted_at", "arrived_at", days_between("predicted_at", "arrived_at").alias("latency_days"),
        (F.col("predicted_value") == F.col("actual_label")).alias("correct"),
    )


def sla_breaches(presented: DataFrame, decisions: DataFrame, *, sla: str, delay: str) -> DataFrame:
    """Reviews that no decision reached within the limit, as soon as the watermark passes it.

    An outer join on time acts as the timer: a review leaves the state matched, or unmatched as a breach.
    ``presented``: prediction_id, presented_at. ``decisions``: decided_id, decided_at.
    """
    p = presented.withWatermark("presented_at", delay)
    d = decisions.withWatermark("decided_at", delay)
    near = F.expr(f"decided_id = prediction_id AND decided_at >= presented_at AND decided_at <= presented_at + INTERVAL {sla}")
    return p.join(d, near, "left_outer").where(F.col("decided_id").isNull()).select("prediction_id", "presented_at")
