"""Feature catalogue, lineage, contract changes and the assembly of training sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from modelward.functions.columns import contains_any
from modelward.functions.ordered import latest_before
from modelward.session import ensure_checkpoint_dir, fresh_folder


def used_by(lineage: DataFrame) -> DataFrame:
    """How many distinct models use each feature."""
    links = lineage.select("feature_id", F.explode("downstream_model_ids").alias("model_id")).distinct()
    return links.groupBy("feature_id").agg(F.count(F.lit(1)).alias("used_by_models"))


def search_catalog(features: DataFrame, lineage: DataFrame, query: str = "", shared_only: bool = False) -> DataFrame:
    """Active features whose name, description or team contains the text, most used first."""
    rows = features.where("is_active")
    if query:
        rows = rows.where(contains_any(query, "feature_name", "feature_description", "owner_team"))
    if shared_only:
        rows = rows.where("is_shared")
    return rows.join(used_by(lineage), "feature_id", "left").fillna(0, ["used_by_models"]).orderBy(F.desc("used_by_models"), "feature_name", "feature_id")


def reuse(features: DataFrame, lineage: DataFrame) -> DataFrame:
    """Shared features, and those that at least two models use."""
    shared = features.where("is_active AND is_shared").select("feature_id")
    return shared.join(used_by(lineage), "feature_id", "left").agg(
        F.count(F.lit(1)).alias("shared_features"), F.count_if(F.coalesce("used_by_models", F.lit(0)) >= 2).alias("multi_consumer_features")
    )


def consumers(lineage: DataFrame, models: DataFrame) -> DataFrame:
    """Distinct projects that consume each feature, for all features at once."""
    links = lineage.select("feature_id", F.explode("downstream_model_ids").alias("model_id")).distinct()
    return links.join(models, "model_id").where(F.col("project_id").isNotNull()).select("feature_id", "project_id").distinct()


def propose_changes(changes: DataFrame, features: DataFrame, uses: DataFrame) -> DataFrame:
    """Status of proposed changes: breaking ones with consumers wait for acknowledgement, the others release at once."""
    counts = uses.groupBy("feature_id").agg(F.count(F.lit(1)).alias("_c"))
    waiting = F.col("is_breaking") & (F.coalesce("_c", F.lit(0)) > 0)
    return (
        changes.join(features.select("feature_id", F.col("feature_version").alias("from_version")), "feature_id")
        .join(counts, "feature_id", "left")
        .withColumn("consumers", F.when(F.col("is_breaking"), F.coalesce("_c", F.lit(0))).otherwise(F.lit(0)))
        .withColumn("status", F.when(waiting, "pending_acks").otherwise("released"))
        .drop("_c")
    )


def pending_acks(changes: DataFrame, uses: DataFrame, acks: DataFrame) -> DataFrame:
    """Consumers that have not acknowledged a waiting change."""
    wanted = changes.where("status = 'pending_acks'").select("change_id", "feature_id").join(uses, "feature_id")
    return wanted.join(acks.select("change_id", "project_id"), ["change_id", "project_id"], "left_anti")


def release_changes(changes: DataFrame, missing: DataFrame) -> DataFrame:
    """Release the waiting changes that no consumer still holds up."""
    held = missing.select("change_id").distinct().withColumn("_held", F.lit(True))
    free = (F.col("status") == "pending_acks") & F.col("_held").isNull()
    return changes.join(held, "change_id", "left").withColumn("status", F.when(free, "released").otherwise(F.col("status"))).drop("_held")


def bump_versions(features: DataFrame, changes: DataFrame, order: str) -> DataFrame:
    """Features at the version of their last released change by the time or number in ``order``; ties go to the later id."""
    to = changes.where("status = 'released'").groupBy("feature_id").agg(F.max_by("to_version", F.struct(order, "change_id")).alias("_to"))
    return features.join(to, "feature_id", "left").withColumn("feature_version", F.coalesce("_to", "feature_version")).drop("_to")


def column_diff(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("contract_id",)) -> DataFrame:
    """Columns added, removed or modified between two versions; removals and type changes break consumers."""
    keys = [*keys, "column_name"]
    was = old.select(*keys, F.col("data_type").alias("old_type"), F.col("is_nullable").alias("old_nullable"), F.lit(True).alias("_was"))
    now = new.select(*keys, F.col("data_type").alias("new_type"), F.col("is_nullable").alias("new_nullable"), F.lit(True).alias("_now"))
    retyped = ~F.col("old_type").eqNullSafe(F.col("new_type"))
    change = (
        F.when(F.col("_was").isNull(), "added")
        .when(F.col("_now").isNull(), "removed")
        .when(retyped | ~F.col("old_nullable").eqNullSafe(F.col("new_nullable")), "modified")
        .otherwise("unchanged")
    )
    breaking = F.col("_was").isNotNull() & (F.col("_now").isNull() | retyped)
    return was.join(now, keys, "full_outer").withColumn("change", change).withColumn("is_breaking", breaking).drop("_was", "_now")


def reusable_features(columns: DataFrame, features: DataFrame) -> DataFrame:
    """Wanted columns that the shared catalogue already offers, grouped per source table."""
    offered = features.where("is_active AND is_shared").select("feature_table_name", F.lower("feature_name").alias("_n")).distinct()
    wanted = columns.select(F.lower("column_name").alias("_n")).distinct()
    return wanted.join(offered, "_n").groupBy("feature_table_name").agg(F.count(F.lit(1)).alias("matches"), F.sort_array(F.collect_set("_n")).alias("feature_names"))


def training_set(base: DataFrame, lookups: Sequence[tuple[DataFrame, Sequence[str], Sequence[str], str | None]], exclude: Sequence[str] = ()) -> DataFrame:
    """Base rows with the features of each lookup: table, key columns, feature columns, and the column of their time.

    A key has the features of its latest row; of rows at one time, those that sort last. A table without a time column must
    hold one row per key, else the query fails. A lookup is reduced to one row per key, so a join never multiplies base rows.
    """
    out = base
    for table, keys, take, latest in lookups:
        if latest is None:
            value = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"several rows of one key, and no time to choose by: {', '.join(keys)}"))).otherwise(F.max(F.struct(*take)))
        else:
            value = F.max_by(F.struct(*take), F.struct(latest, *take))
        out = out.join(table.groupBy(*keys).agg(value.alias("_f")).select(*keys, "_f.*"), list(keys), "left")
    return out.drop(*exclude)


def point_in_time_set(labels: DataFrame, features: DataFrame, keys: Sequence[str], label_ts: str, feature_ts: str, tie: str, take: Sequence[str], lookback_days: int | None = None, bucket_seconds: int = 3600) -> DataFrame:
    """Each label with the feature values known at its time."""
    lookback = None if lookback_days is None else lookback_days * 86400
    return latest_before(labels, features, keys, label_ts, feature_ts, tie, take, bucket_seconds, lookback)


def pinned_features(features: DataFrame, pins: DataFrame) -> DataFrame:
    """Feature rows at the version a project pinned; projects without a pin see the newest version.

    Versions are ordered by the first number in them, v9 before v10, and then as text.
    """
    order = F.struct(F.expr(r"try_cast(regexp_extract(feature_version, '([0-9]+)', 1) AS bigint)"), F.col("feature_version"))
    newest = features.groupBy("feature_id").agg(F.max_by("feature_version", order).alias("_newest"))
    chosen = pins.join(newest, "feature_id").select("project_id", "feature_id", F.coalesce("pinned_version", "_newest").alias("feature_version"))
    return chosen.join(features, ["feature_id", "feature_version"])


def entity_features(events: DataFrame, entity: str, ts: str, value: str, windows: Mapping[str, int]) -> DataFrame:
    """Per entity and day of activity: lifetime and rolling sums, counts and means, and days since the day before.

    Events are first summed per entity and day, so the windows see one row per day.
    """
    daily = events.groupBy(entity, F.to_date(ts).alias("feature_date")).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    daily = daily.withColumn("_d", F.datediff("feature_date", F.lit("1970-01-01").cast("date")))
    along = Window.partitionBy(entity).orderBy("_d")
    life = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols = [
        F.sum("_s").over(life).alias("lifetime_sum"), F.sum("_n").over(life).alias("lifetime_count"),
        (F.col("_d") - F.lag("_d").over(along)).alias("days_since_last"),
    ]
    for name, days in windows.items():
        w = along.rangeBetween(-(days - 1), 0)
        cols += [F.sum("_s").over(w).alias(f"sum_{name}"), F.sum("_n").over(w).alias(f"count_{name}"), (F.sum("_s").over(w) / F.sum("_n").over(w)).alias(f"mean_{name}")]
    return daily.select(entity, "feature_date", *cols)


def downstream(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Everything reachable from each source node, with the smallest number of hops; ``edges``: parent, child.

    Sources are numbered and a node keeps those that reach it as bits, 64 sources to a row. Each hop passes on only the bits
    that its nodes have just got, takes off those that the next nodes already have, and ends when none is left; so cycles
    end by themselves and any depth is followed. What a hop finds is written to the shared folder once, and the bits of all
    hops so far are put together whenever they have doubled. Pairs of source and node are made only at the end.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    folder = fresh_folder(spark, "downstream")
    links = edges.where(F.col("parent").isNotNull() & F.col("child").isNotNull()).select("parent", "child").distinct().checkpoint()
    # numbers of a written table stay as they are; they need not be without gaps
    numbered = sources.select("source").where(F.col("source").isNotNull()).distinct().withColumn("_no", F.monotonically_increasing_id()).checkpoint()
    bit = F.element_at(F.array(*[F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b) for b in range(64)]), (F.col("_no").bitwiseAND(F.lit(63)) + 1).cast("int"))
    named = numbered.select("source", F.shiftright("_no", 6).alias("word"), F.col("_no").bitwiseAND(F.lit(63)).cast("int").alias("bit"), bit.alias("bits"))
    front = named.groupBy(F.col("source").alias("node"), "word").agg(F.bit_or("bits").alias("bits")).checkpoint()
    seen, since, rows, size, hop = front, [], None, 0, 0
    total = front.count()
    while rows != 0:
        hop += 1
        step = front.join(links, front.node == links.parent).groupBy(F.col("child").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))
        held = seen
        for part in since:
            held = held.unionByName(part)
        # only what stands at the step's own nodes is put together
        held = held.join(step.select("node", "word"), ["node", "word"], "left_semi").groupBy("node", "word").agg(F.bit_or("bits").alias("_had"))
        new = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_had", F.lit(0).cast("long"))))
        count = Observation()
        fresh = step.join(held, ["node", "word"], "left").select("node", "word", new.alias("bits")).where("bits != 0")
        fresh.observe(count, F.count(F.lit(1)).alias("rows")).write.parquet(f"{folder}/hop={hop}")
        rows = count.get["rows"]
        front = spark.read.schema(fresh.schema).parquet(f"{folder}/hop={hop}")
        since, size = [*since, front], size + rows
        if size > total or len(since) >= 16:
            whole = seen
            for part in since:
                whole = whole.unionByName(part)
            seen, since, total, size = whole.groupBy("node", "word").agg(F.bit_or("bits").alias("bits")).checkpoint(), [], total + size, 0
    reached = spark.read.schema(StructType([*fresh.schema.fields, StructField("hop", LongType())])).parquet(folder)
    bits = F.explode(F.expr("filter(sequence(0, 63), b -> getbit(bits, b) = 1)")).alias("bit")
    pairs = reached.select("node", "word", F.col("hop").cast("int").alias("hops"), bits)
    return pairs.join(named.select("source", "word", "bit"), ["word", "bit"]).select("source", "node", "hops")


def top_contributions(contributions: DataFrame, key: str, weights: str, k: int) -> DataFrame:
    """The k features with the largest absolute weight per row."""
    # bounded per row: a row's own map is ranked inside the row, without a shuffle
    ranked = F.slice(
        F.array_sort(
            F.map_entries(weights),
            lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1).when(F.abs(a["value"]) < F.abs(b["value"]), 1).when(a["key"] < b["key"], -1).otherwise(1),
        ),
        1, k,
    )
    return contributions.select(key, F.posexplode(ranked).alias("_pos", "_e")).select(key, (F.col("_pos") + 1).alias("rank"), F.col("_e.key").alias("feature"), F.col("_e.value").alias("weight"))


def mean_contributions(contributions: DataFrame, weights: str, k: int) -> DataFrame:
    """The k features with the largest mean absolute weight over all rows."""
    cells = contributions.select(F.explode(weights).alias("feature", "weight"))
    return cells.groupBy("feature").agg(F.avg(F.abs("weight")).alias("mean_abs_weight")).orderBy(F.desc("mean_abs_weight"), "feature").limit(k)


def sensitive_in_top(top: DataFrame, sensitive: Sequence[str] | Column) -> DataFrame:
    """Top-ranked features that are protected or proxies, to review."""
    hit = F.lower("feature").isin([s.lower() for s in sensitive]) if not isinstance(sensitive, Column) else sensitive
    return top.where(hit)
