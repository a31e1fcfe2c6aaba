"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelward.llm import decontamination, mixing, near_dedup, queries, toxicity
from modelward.session import ensure_checkpoint_dir, fresh_folder

#: No SQL: the first stage is a trained model. Stages are tested against brute force instead.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; all of them if there are no labels to learn from.

    Null and empty texts are clean; repeated rows share their fate; all columns are kept, and an empty table stays empty.
    """
    model = toxicity.trained(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.filtered(docs, model)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near copies, on shingles of five words; equal rows of an id and text are one.

    Of a group the text of the smallest id stays, of texts with one id that of the smallest hash. Null and empty texts are
    linked with nothing and stay; rows without an id are told by their texts. An empty table stays empty.
    """
    ensure_checkpoint_dir(spark)
    queries.table(spark, sf_dir, "documents")
    named = [F.coalesce(F.col("doc_id").cast("long"), F.lit(near_dedup.NO_ID)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")]
    kept = near_dedup.near_texts(docs, words=5, percent=80).where("kept").select("doc", "mark")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *named)
    return rows.join(kept, ["doc", "mark"], "left_semi").dropDuplicates(["doc", "mark"]).select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows go by their text, whatever their id.

    Null and empty texts hold nothing; repeated rows share their fate; without benchmark items all rows stay.
    """
    ensure_checkpoint_dir(spark)
    text = F.coalesce("text", F.lit(""))
    # 128 bits and the length: no clean text has the name of another
    mark = F.concat(F.md5(text.cast("binary")), F.octet_length(text).cast("string")).alias("mark")
    marked = docs.select(mark, "text")
    found = decontamination.contaminated(marked, queries.table(spark, sf_dir, "benchmark"), id_column="mark").select(F.col("doc_id").alias("mark")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), mark)
    return rows.join(found, "mark", "left_anti").select("row.*")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is one source. Documents without words stay once; repeated rows are documents of their own, ties of the
    sampling order are broken by size. An empty table stays empty.
    """
    ensure_checkpoint_dir(spark)
    return mixing.repeated_rows(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in files; the place, length and checksum of every document's ids, from the files.

    Null texts hold the end id alone; null ids come first; rows that share an id are ordered by a hash of their texts, then
    the texts. An empty table gives no rows.
    """
    queries.table(spark, sf_dir, "documents")
    return queries.token_digest(spark, docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed_sources),
    ("token_files", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to a new shared folder and read again."""
    ensure_checkpoint_dir(spark)
    docs, folder = queries.table(spark, sf_dir, "documents"), fresh_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
