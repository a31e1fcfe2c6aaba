"""State transitions as functions from the current table and its changes to the next table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from modelward.functions.bloom import BITS, bloom_filter, may_hold
from modelward.functions.columns import instant, row_id, within_days
from modelward.functions.ordered import running_totals, with_previous
from modelward.functions.relational import null_safe_join, top_per_key


def merge_upsert(
    current: DataFrame, changes: DataFrame, keys: Sequence[str], update: Sequence[str], order: Sequence[Column], action: str | None = None
) -> DataFrame:
    """Update the listed columns of matched keys and insert the rest.

    Several changes for one key are reduced to the first by ``order``. ``action`` names an extra column that says
    ``updated``, ``inserted`` or ``kept``. Columns that ``changes`` lacks are NULL on inserted rows.
    """
    keys = list(keys)
    one = top_per_key(changes, keys, order)
    given = [c for c in current.columns if c in one.columns and c not in keys]
    src = one.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_s_{c}") for c in given], F.lit(True).alias("_new"))
    dst = current.withColumn("_old", F.lit(True))
    cond = None
    for k in keys:
        c = F.col(k) == F.col(f"_k_{k}")
        cond = c if cond is None else cond & c
    both = dst.join(src, cond, "full_outer")
    matched, fresh = F.col("_new") & F.col("_old"), F.col("_old").isNull()
    cols = []
    for c in current.columns:
        if c in keys:
            cols.append(F.coalesce(F.col(c), F.col(f"_k_{c}")).alias(c))
        elif c in given:
            taken = fresh | matched if c in update else fresh
            cols.append(F.when(taken, F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    if action:
        cols.append(F.when(fresh, "inserted").when(matched, "updated").otherwise("kept").alias(action))
    return both.select(*cols)


def upsert_touched(current: DataFrame, changes: DataFrame, keys: Sequence[str], update: Sequence[str], order: Sequence[Column], partition: str) -> DataFrame:
    """Next rows of the partitions that ``changes`` touches; the others need no rewrite.

    Write the result with ``tables.overwrite_partitions``.
    """
    touched = changes.select(partition).distinct()
    return merge_upsert(current.join(touched, partition, "left_semi").select(*current.columns), changes, keys, update, order)


def insert_if_absent(current: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None, bits: int = BITS) -> DataFrame:
    """Rows of ``new`` whose key ``current`` does not hold: what a write should append; with ``order``, one per key.

    A Bloom filter of the new keys is applied where the target is read, so only target rows that may meet a new one are
    shuffled: their number goes by the new rows, not by the target's.
    """
    one = top_per_key(new, keys, order) if order else new
    met = current.select(*keys).where(may_hold(bloom_filter(new, keys, bits), [F.col(k) for k in keys], bits))
    return one.join(met, list(keys), "left_anti")


def replace_rows(current: DataFrame, replacement: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop all current rows of the keys that ``replacement`` brings, then add its rows."""
    return current.join(replacement.select(*keys).distinct(), list(keys), "left_anti").unionByName(replacement)


def next_versions(current: DataFrame, new: DataFrame, key: str, version: str, order: str, newest: str | None = None) -> DataFrame:
    """Number new rows of a key onward from its highest version, in the order of a unique column of numbers or times.

    The order is that of the column's own type, so 64-bit numbers keep apart. ``newest`` names an extra column that marks the last row of each key.
    """
    top = current.groupBy(key).agg(F.max(version).alias("_top"))
    placed = running_totals(new.select(key, order, F.lit(1).alias("_one")), [key], order, ["_one"])
    numbered = new.join(placed, [key, order])
    cols = [*new.columns, (F.coalesce("_top", F.lit(0)) + F.col("_one_below") + 1).alias(version)]
    if newest:
        cols.append((F.col("_one_below") + 1 == F.col("_one_total")).alias(newest))
    return numbered.join(top, key, "left").select(*cols)


def supersede(current: DataFrame, new: DataFrame, key: str, version: str, order: str, active: str = "is_active") -> DataFrame:
    """Close the active rows of the keys with new rows and add these as the following versions; the newest is active."""
    replaced = new.select(key).distinct().withColumn("_replaced", F.lit(True))
    kept = current.join(replaced, key, "left").withColumn(active, F.col(active) & F.col("_replaced").isNull()).drop("_replaced")
    return kept.unionByName(next_versions(current, new, key, version, order, newest=active), allowMissingColumns=True)


def latest_per_key(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The row with the highest ``order`` columns of each key."""
    return top_per_key(df, keys, [F.desc(c) for c in order])


def newest(df: DataFrame, ts: str, tie: str, n: int = 1) -> DataFrame:
    """The ``n`` newest rows of a log."""
    return df.orderBy(F.desc(ts), F.asc(tie)).limit(n)


def run_health(runs: DataFrame, job: str = "job_name", ts: str = "run_timestamp") -> DataFrame:
    """Status of each pass: failed on error, warning when nothing changed although the run before changed rows.

    Failed runs are passed over when looking back.
    """
    ok = F.col("error").isNull()
    prior = with_previous(runs.where(ok), [job], ts, ["run_id"], {"rows_changed": "_prev"}, bucket_seconds=86400 * 30)
    quiet = (F.col("rows_changed") == 0) & (F.coalesce("_prev", F.lit(0)) > 0)
    good = prior.withColumn("status", F.when(quiet, "warning").otherwise("ok")).withColumn(
        "detail", F.when(quiet, "changed 0 rows where the run before changed some: the source may have changed shape").otherwise("")
    )
    bad = runs.where(~ok).withColumn("status", F.lit("failed")).withColumn("detail", F.col("error"))
    return good.drop("_prev").unionByName(bad)


def stale_passes(runs: DataFrame, cadence_hours: Column, as_of, job: str = "job_name", ts: str = "run_timestamp") -> DataFrame:
    """Last good run of each job against its cadence."""
    last = runs.where(F.col("status").isin("ok", "warning")).groupBy(job).agg(F.max(ts).alias("last_good_run"))
    hours = F.timestamp_diff("HOUR", F.col("last_good_run"), instant(as_of))
    return last.withColumn("hours_since", hours).withColumn("is_stale", hours > cadence_hours)


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and a checksum that row order does not change."""
    h = F.xxhash64(*[F.col(c) for c in df.columns], *[F.col(c).isNull() for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).cast("string").alias("checksum"))


def text_fingerprint(df: DataFrame, columns: Sequence[str], digits: int = 12) -> DataFrame:
    """As ``fingerprint``, from leading digits of MD5 sums, which other engines can recompute; NULL has a mark of its own."""
    marked = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("!")) for c in columns]
    part = F.conv(F.substring(F.md5(F.concat_ws("|", *marked)), 1, digits), 16, 10)
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.sum(part.cast("decimal(20,0)")).cast("string").alias("checksum"))


def key_fingerprints(df: DataFrame, key: str, columns: Sequence[str], out: str, digits: int = 12) -> DataFrame:
    """`text_fingerprint` of each key's rows as one text; the order of rows does not matter, their number does."""
    marked = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("!")) for c in columns]
    part = F.conv(F.substring(F.md5(F.concat_ws("|", *marked)), 1, digits), 16, 10)
    return df.groupBy(key).agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(part.cast("decimal(20,0)")).cast("string")).alias(out))


def guarded_publish(recorded: DataFrame, found: DataFrame, proposed: DataFrame, key: str, columns: Sequence[str], force: bool = False) -> DataFrame:
    """`publish_decisions` for each key of the proposed rows, from the contents last written, now found and to be written."""
    sides = [key_fingerprints(df, key, columns, name) for df, name in ((proposed, "proposed"), (found, "found"), (recorded, "recorded"))]
    return publish_decisions(sides[0].join(sides[1], key, "left").join(sides[2], key, "left"), force)


def publish_decisions(tables: DataFrame, force: bool = False) -> DataFrame:
    """Whether each published table may be overwritten, from fingerprints (recorded, found, proposed).

    A table that is not what was last recorded is blocked unless forced; one that already equals the new data is left.
    """
    drifted = F.col("recorded").isNotNull() & F.col("found").isNotNull() & (F.col("found") != F.col("recorded")) & F.lit(not force)
    same = F.coalesce(F.col("found") == F.col("proposed"), F.lit(False))
    return tables.withColumn("outcome", F.when(drifted, "blocked").when(same, "unchanged").otherwise("write"))


def settings_hash(settings: Column) -> Column:
    """SHA-256 of a string map written as JSON in key order, without its own embedded hash."""
    clean = F.map_filter(settings, lambda k, _: k != "config_hash")
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(clean)))), 256)


def lifecycle_moves(log: DataFrame, allowed: Mapping[str, Sequence[str]], key: str, state: str, ts: str, tie: Sequence[str], bucket_seconds: int = 3600) -> DataFrame:
    """Each state change with its verdict; the first state of a key is always valid."""
    moves = with_previous(log, [key], ts, tie, {state: "from_state"}, bucket_seconds)
    ok = F.col("from_state").isNull()
    for origin, targets in allowed.items():
        ok = ok | ((F.col("from_state") == origin) & F.col(state).isin(*targets))
    return moves.withColumn("is_valid", ok)


def purge(df: DataFrame, ts: str, keep_days: int | Column, as_of) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, rows past their retention)."""
    young = F.coalesce(within_days(ts, as_of, keep_days), F.lit(True))
    return df.where(young), df.where(~young)


def retention_pass(df: DataFrame, ts: str, keep_days: int, as_of, archive: str) -> tuple[DataFrame, int]:
    """Rows to keep, and how many were past their retention: these are written to the archive first.

    The archive has a folder for each time of a pass, so a repeated pass replaces its own rows. What to keep is only returned
    once the archive is complete; rows without a time are kept.
    """
    keep, gone = purge(df, ts, keep_days, as_of)
    seen = Observation()
    day = str(as_of).replace(":", "").replace(" ", "T")
    gone.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{archive}/as_of={day}")
    return keep, int(seen.get["rows"])


# Days to keep each class of table.
RETENTION_DAYS = {"telemetry": 90, "predictions": 180, "metrics": 365, "audit": 2555}


def audit_rows(
    df: DataFrame, *, action: str | Column, actor: str | Column, role: str, resource_type: str, resource_id: str, as_of, details: Column, project: str | None = None
) -> DataFrame:
    """Audit events for the rows of a transition, ready to append."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(
        row_id(as_col(action), F.lit(resource_type), F.col(resource_id).cast("string"), F.lit(str(as_of))).alias("event_id"),
        as_col(action).alias("action_type"),
        as_col(actor).alias("actor_email"),
        F.lit(role).alias("actor_role"),
        F.lit(resource_type).alias("resource_type"),
        F.col(resource_id).cast("string").alias("resource_id"),
        (F.col(project) if project else F.lit(None).cast("string")).alias("project_id"),
        details.alias("change_details"),
        instant(as_of).alias("event_timestamp"),
    )


def merged_audit(events: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Several audit logs of one shape as one, each row naming its source."""
    out = None
    for source, df in events:
        rows = df.withColumn("source", F.lit(source))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


AUDIT_COLUMNS = ("event_timestamp", "actor", "action", "resource_type", "resource_id", "project_id")


def normalised_audit(sources: Mapping[str, tuple[DataFrame, Mapping[str, Column]]]) -> DataFrame:
    """Logs of different shapes as one list of events, newest first; ties go by source, action and resource.

    A source says how each of AUDIT_COLUMNS is read; what it leaves out is NULL. All its other columns are kept as JSON.
    """
    out = None
    for source, (df, how) in sources.items():
        details = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
        rows = df.select(F.lit(source).alias("source"), *[how.get(c, F.lit(None)).cast("timestamp_ntz" if c == "event_timestamp" else "string").alias(c) for c in AUDIT_COLUMNS], details.alias("details"))
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy(F.desc("event_timestamp"), "source", "action", "resource_id", "details")


def refresh_aliases(versions: DataFrame, registry: DataFrame) -> DataFrame:
    """Set each version's aliases to what the registry holds now; versions without any get an empty list."""
    now = registry.groupBy("uc_full_name", "uc_version").agg(F.sort_array(F.collect_set("alias")).alias("_aliases"))
    return null_safe_join(versions.drop("current_aliases"), now, ["uc_full_name", "uc_version"], "left").select(
        *[c for c in versions.columns if c != "current_aliases"], F.coalesce("_aliases", F.array().cast("array<string>")).alias("current_aliases")
    )


def contract_history(changes: DataFrame, columns: DataFrame, current_versions: DataFrame) -> DataFrame:
    """One history row per changed contract: next version, kind of change, and the column list as JSON."""
    kind = F.max(F.when(F.col("is_breaking"), 2).when(F.col("change") != "unchanged", 1).otherwise(0))
    kinds = changes.groupBy("contract_id").agg(kind.alias("_k")).where(F.col("_k") > 0)
    cols = columns.groupBy("contract_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("column_name", "data_type", "is_nullable")))).alias("snapshot"))
    top = current_versions.groupBy("contract_id").agg(F.max("version").alias("_top"))
    return (
        kinds.join(cols, "contract_id", "left")
        .join(top, "contract_id", "left")
        .select("contract_id", (F.coalesce("_top", F.lit(0)) + 1).alias("version"), F.when(F.col("_k") == 2, "breaking").otherwise("compatible").alias("change_type"), "snapshot")
    )
