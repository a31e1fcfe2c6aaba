"""Reading, sampling, describing and appending tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from modelward.functions.identifiers import check_table

# Name prefixes of scratch tables.
SCRATCH_PREFIXES = ("zz_", "scratch_", "tmp_")
DEFAULT_SAMPLE_ROWS = 5000


def scan(spark: SparkSession, table: str) -> DataFrame:
    """A catalog table by its one- to three-part name; unsafe names are refused before any job starts."""
    return spark.read.table(check_table(table))


def run_sql(spark: SparkSession, text: str, params: Mapping | None = None, **tables: DataFrame) -> DataFrame:
    """SQL with named markers; values are bound with their own type, never spliced into the text."""
    return spark.sql(text, args=dict(params or {}), **tables)


def sample_rows(df: DataFrame, n: int = DEFAULT_SAMPLE_ROWS, key: str | None = None) -> DataFrame:
    """``n`` rows: the same ones on every run when ``key`` names a unique column, else whichever come first."""
    if key is None:
        return df.limit(n)
    return df.orderBy(F.md5(F.col(key).cast("string")), F.col(key)).limit(n)


def infer_schema(df: DataFrame) -> DataFrame:
    """Column name, type and comment of a table, in order."""
    rows = [(i, f.name, f.dataType.simpleString(), (f.metadata or {}).get("comment")) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "column_order INT, column_name STRING, data_type STRING, comment STRING")


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> int:
    """Append rows to a parquet log and return how many; the count is taken while writing."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return int(seen.get["rows"])


def record_pass(job: str, source: DataFrame, run, path: str, log_path: str, as_of) -> DataFrame:
    """Run one pass, write its result and log rows examined and rows changed.

    ``run`` maps the source to the rows to write. Both counts are observed while the result is written. Result and log row
    stand in folders named by the job and its time, so a pass that is repeated replaces what it wrote before. A failed pass
    leaves no result, is logged with its error and raises it. ``state.run_health`` turns the log into statuses.
    """
    spark = source.sparkSession
    run_id = hashlib.sha256(f"{job}:{as_of}".encode()).hexdigest()

    def log(examined: int, changed: int, error: str | None) -> DataFrame:
        row = spark.range(1).select(
            F.lit(job).alias("job_name"), F.lit(examined).cast("long").alias("rows_examined"), F.lit(changed).cast("long").alias("rows_changed"), F.lit(error).cast("string").alias("error"),
            F.lit(str(as_of)).cast("timestamp_ntz").alias("run_timestamp"),
        )
        row.coalesce(1).write.mode("overwrite").parquet(f"{log_path}/run_id={run_id}")
        return row.withColumn("run_id", F.lit(run_id))

    seen, written = Observation(), Observation()
    try:
        counted = source.observe(seen, F.count(F.lit(1)).alias("rows"))
        run(counted).observe(written, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/run_id={run_id}")
    except Exception as e:
        log(0, 0, str(e))
        raise
    return log(int(seen.get["rows"]), int(written.get["rows"]), None)


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions that ``df`` holds; each is swapped in when the whole write has succeeded."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def import_csv(spark: SparkSession, path: str, contract_id: str) -> tuple[DataFrame, DataFrame]:
    """(rows, contract columns) of a CSV file with a header; types are detected from the values."""
    df = spark.read.csv(path, header=True, inferSchema=True, multiLine=False)
    columns = infer_schema(df).select(F.lit(contract_id).alias("contract_id"), "column_order", "column_name", "data_type", F.lit(True).alias("is_nullable"))
    return df, columns


def scratch_tables(spark: SparkSession, schema: str, prefixes: Iterable[str] = SCRATCH_PREFIXES) -> DataFrame:
    """Tables of a schema that look like scratch; dropping them is up to the caller."""
    check_table(schema)
    names = [(f"{schema}.{t.name}",) for t in spark.catalog.listTables(schema) if t.name.startswith(tuple(prefixes))]
    return spark.createDataFrame(names, "table_name STRING")


def generated_rows(spark: SparkSession, n: int, null_every: Mapping[str, int] | None = None) -> DataFrame:
    """Test rows from a hash of the row number, so every run yields the same; named columns get NULLs."""
    h = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m))
    df = spark.range(n).select(
        F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("customer_id"), (h("age", 60) + 18).cast("int").alias("age"), h("tenure", 72).cast("int").alias("tenure_months"),
        (h("charge", 10000) / 100.0).alias("monthly_charges"), (h("churn", 100) < 27).cast("int").alias("churn_flag"), "id",
    )
    for name, every in (null_every or {}).items():
        df = df.withColumn(name, F.when(h(f"null-{name}", every) != 0, F.col(name)))
    return df.drop("id")
