"""Snapshots of tables with a manifest, and published versions of a table.

Each write goes to a new folder and becomes visible by one appended manifest row, so a lost executor or a failed write
leaves the last version as it was. One writer per table is assumed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from modelward.functions.columns import row_id
from modelward.functions.identifiers import check_table

MANIFEST = "snapshot_id STRING, project_id STRING, source_table STRING, snapshot_table STRING, path STRING, source_version BIGINT, row_count BIGINT, created_at TIMESTAMP_NTZ, created_by STRING"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """All manifest rows; none before the first write."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)


def _record(df: DataFrame, root: str, path: str, **fields) -> DataFrame:
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    spark = df.sparkSession
    cols = {"path": path, "row_count": int(seen.get["rows"]), **fields}
    row = spark.range(1).select(
        row_id(F.lit(cols["project_id"]), F.lit(cols["source_table"]), F.lit(path)).alias("snapshot_id"),
        *[F.lit(cols.get(n)).cast(t).alias(n) for n, t in (c.rsplit(" ", 1) for c in MANIFEST.split(", ")) if n != "snapshot_id"],
    )
    row.coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return row


def snapshot(spark: SparkSession, root: str, df: DataFrame, *, project_id: str, source_table: str, as_of, created_by: str = "", source_version: int | None = None) -> DataFrame | None:
    """Copy a table once per project and source; None when a copy exists."""
    check_table(source_table)
    done = manifest(spark, root).where((F.col("project_id") == project_id) & (F.col("source_table") == source_table))
    if not done.isEmpty():
        return None
    at = str(as_of)
    name = f"snapshot_{source_table.rsplit('.', 1)[-1]}_{at[:10].replace('-', '')}_{at[11:19].replace(':', '') or '000000'}"
    return _record(df, root, f"{root}/data/{project_id}/{name}", project_id=project_id, source_table=source_table, snapshot_table=name, source_version=source_version, created_at=at, created_by=created_by)


def snapshot_all(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], *, project_id: str, as_of, created_by: str = "") -> list[dict]:
    """Snapshot each table that has no copy yet; a failure is reported and does not stop the others."""
    out = []
    for name, df in tables.items():
        try:
            made = snapshot(spark, root, df, project_id=project_id, source_table=name, as_of=as_of, created_by=created_by)
            out.append({"source_table": name, "status": "skipped" if made is None else "copied"})
        except Exception as e:
            out.append({"source_table": name, "status": "failed", "error": str(e)})
    return out


def current_version(spark: SparkSession, root: str, table: str) -> int | None:
    """Highest published version, NULL when the table has no history."""
    return manifest(spark, root).where(F.col("source_table") == table).agg(F.max("source_version")).first()[0]


def publish(spark: SparkSession, root: str, table: str, df: DataFrame, as_of) -> int:
    """Write the next version of a table and make it the current one."""
    check_table(table)
    version = (current_version(spark, root, table) or 0) + 1
    _record(df, root, f"{root}/data/{table}/v={version}", project_id="", source_table=table, snapshot_table=table, source_version=version, created_at=str(as_of), created_by="")
    return version


def read_current(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The current version of a published table."""
    newest = manifest(spark, root).where(F.col("source_table") == table).orderBy(F.desc("source_version")).select("path").first()
    if newest is None:
        raise ValueError(f"{table} has not been published")
    return spark.read.parquet(newest["path"])


def version_manifest(manifest_rows: DataFrame, lineage: DataFrame, quality: DataFrame, code_hash: str, parents: DataFrame | None = None) -> DataFrame:
    """Data-version record per project: its sources with versions and counts, downstream models, quality and code hash.

    ``parents`` (project_id, parent_dataset) are the data versions it was made from; they are listed, and part of its id.
    """
    sources = manifest_rows.groupBy("project_id").agg(
        F.sort_array(F.collect_list(F.struct("source_table", "source_version", "row_count"))).alias("sources"), F.sum("row_count").alias("total_rows")
    )
    rows = sources.join(lineage, "project_id", "left").join(quality, "project_id", "left").withColumn("code_hash", F.lit(code_hash))
    named = ["project_id", F.to_json("sources"), "code_hash"]
    if parents is not None:
        listed = parents.groupBy("project_id").agg(F.sort_array(F.collect_set("parent_dataset")).alias("parent_datasets"))
        rows = rows.join(listed, "project_id", "left").withColumn("parent_datasets", F.coalesce("parent_datasets", F.array().cast("array<string>")))
        named.append(F.to_json("parent_datasets"))
    return rows.withColumn("data_version_id", F.sha2(F.concat_ws(":", *named), 256))
