"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelward.llm import decontamination, exact_dedup, hard_negatives, html_text, merkle_manifest, mixing, near_dedup, quality, secret_scan, token_counts, token_files, toxicity, url_filters
from modelward.llm.sql import ORACLES
from modelward.session import ensure_checkpoint_dir, fresh_folder, ship_package


#: The rules of the url query.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; what its queries run in Python on the executors is sent along."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secret_scan.secret_digest(secret_scan.secret_scan(table(spark, sf_dir, "documents")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("words")).checkpoint()  # texts are read once
    return mixing.sampled_mix(sized, size_column="words").select("doc_id", "size", "source_size", "target", "taken")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.trained(docs, table(spark, sf_dir, "labels")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold."""
    ensure_checkpoint_dir(spark)
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document, on word pairs."""
    ensure_checkpoint_dir(spark)
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extracted_text(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    scores = toxicity.toxicity_scores(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", "held_out", "score", "predicted", F.size("offending").cast("long").alias("n_offending"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    """The tokenizer file of the token queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary())


def token_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Writes the documents' ids to files of a new shared folder, reads them back and places every document."""
    ensure_checkpoint_dir(spark)
    folder = fresh_folder(spark, "token_files")
    token_files.write_token_files(docs, folder, vocabulary())
    return token_files.token_starts(token_files.read_token_files(spark, folder).checkpoint())


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, from the files."""
    return token_digest(spark, table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor; a seventh of the labels is changed first."""
    vec_id, label = F.col("vec_id"), F.col("label")
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.hard_negatives(vectors, vec_id % 50 == 0)


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return url_filters.url_verdicts(table(spark, sf_dir, "pages"), rules)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document."""
    return merkle_manifest.merkle_manifest(table(spark, sf_dir, "documents")).drop("proof")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secrets, op2_quality, op3_mixing, op4_decontamination, op5_near_dedup, op6_html_text, op7_toxicity, op8_exact_dedup, op9_token_counts, op10_token_files, op11_hard_negatives, op12_url_filters, op13_merkle_manifest)}
