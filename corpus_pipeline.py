"""From raw documents to token ids: each stage keeps, changes or drops documents for the next one.

Null and empty texts, and texts without letters, go in the first stage; other rows with odd values in any column pass with
the values they have. Rows that repeat an id are one group of copies, of which one stays; rows without an id all stay. An
empty table stays empty. Columns beside those named here are kept, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semcorpus.llm import byte_bpe, decontaminate, language_id, minhash_dedup, secret_scan
from semcorpus.llm.batches import small_batches
from semcorpus.llm.components import cut


# Rows that travel between Spark and Python at a time: texts are long, and the workers of several stages live side by side.
ROWS = 256


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the corpus; texts without letters, or that fit none, go."""
    small_batches(spark, ROWS)
    model = language_id.train(docs, "text", "lang", F.col("doc_id"))
    return language_id.recognised(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: word shingles of five, similarity 0.8 or more."""
    small_batches(spark, ROWS)
    return minhash_dedup.deduplicated(docs, percent=80)


def unseen_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with a benchmark item."""
    small_batches(spark, ROWS)
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    small_batches(spark, ROWS)
    return secret_scan.redacted(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, their number, and the hash of the bytes that they decode to."""
    small_batches(spark, ROWS)
    vocab = byte_bpe.default_vocabulary()
    both = byte_bpe.decode(byte_bpe.encode(docs, vocab), vocab)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("bytes", 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", unseen_in_benchmark),
    ("secret_scan", without_secrets),
    ("byte_bpe", token_ids),
]

# A trained classifier, signatures and merges are not for SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
