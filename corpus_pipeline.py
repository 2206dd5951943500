"""A training corpus from raw documents: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlane.llm import bpe, decontaminate, exact_dedup, language_id, shingle_dedup, simhash
from rasterlane.llm.common import shared_path, table

#: Bytes of a generation of the encoder's cache: a worker has served the other stages before.
CACHE = 8 << 20
#: Rows that Spark sends to Python at once (10,000 otherwise, which is 35 MB of text several times over).
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Held by the session from the first stage on, as plans read it when they are run; a smaller value stays."""
    if not 0 < int(spark.conf.get(BATCH)) <= BATCH_ROWS:
        spark.conf.set(BATCH, BATCH_ROWS)


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no letter, or no n-grams of any learned language beyond accident.

    Where no row has a label there is nothing to learn, and documents with a letter stay.
    """
    small_batches(spark)
    model = language_id.fit(language_id.training(docs))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return language_id.identify(docs, model).where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") > 0)).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the smallest id stays.

    First the vantage-point trees drop what is within 2 bits of SimHash over 5-word shingles; of the
    rest, what has 0.8 or more of its 5-word shingles in common.
    """
    small_batches(spark)
    return shingle_dedup.keep_one(docs, among=simhash.kept_keys(docs, width=5, radius=2))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    small_batches(spark)
    return bpe.round_trip(docs, cache=CACHE)


STAGES = [
    ("language_id", by_language),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmark_leaks),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Language filters, trees and merges are beyond SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None
