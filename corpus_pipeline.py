"""A corpus pipeline over ``documents``: five stages, each one operator of hirelens.llm.

Each stage gets all rows that the stage before kept and returns the columns of
documents; the last returns the pieces of packed sequences. Null texts count as
empty, repeated rows are rows of their own, and an empty table gives no pieces.

Whole texts go to Python and back, so every stage asks for small Arrow batches:
they bound what a worker and its executor hold at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hirelens.llm import lines, packing, quality, secrets, simhash
from hirelens.sources.shared import scratch_folder, stored


BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Batches of at most ``BATCH_ROWS`` texts from now on; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer rejects go."""
    small_batches(spark)
    return quality.keep_good(docs, quality.train(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller id holds go from the text."""
    small_batches(spark)
    return lines.dedup_lines(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    small_batches(spark)
    return simhash.keep_one(docs, words=3, max_bits=2)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; no document goes."""
    small_batches(spark)
    return secrets.redact(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    small_batches(spark)
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("simhash near-dedup", simhash_dedup),
    ("secret scans", secret_scans),
    ("packing", sequence_packing),
]

# Models, fingerprints and tokenizers are beyond SQL; tests/llm holds it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, f"{folder}/{number}")
    return docs
