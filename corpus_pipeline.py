"""A training corpus from ``documents``: quality rules, near-duplicates, secrets, source mix, token ids.

Each stage works on all that its predecessor kept and its decisions take effect: bad documents go, one
document of each near-duplicate group stays, secrets are blanked, documents are repeated or left out to meet
the source weights, and texts become token ids.  Every stage but the last returns the columns of
``documents``; ``n_chars`` follows the text.  Rows with null ids, texts or sources are handled as the stages'
operators say; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, mixing, quality, secret_scan, similar_sets
from tessera.session import shared_folder, ship_package


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that the rules reject."""
    ship_package(spark)
    return _recounted(quality.keep_good(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    SimHash links and those of an exact join on five-word shingles, both verified at a similarity of 0.8."""
    ship_package(spark)
    return similar_sets.drop_near_duplicates(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    ship_package(spark)
    return _recounted(secret_scan.redact(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    ship_package(spark)
    return mixing.mixed_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source``, the packed token ids, their number and digests."""
    ship_package(spark)
    return bpe.round_trip(docs, keep=["doc_id", "source"])


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: SQL has neither XXH64 nor the tokenizer; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
