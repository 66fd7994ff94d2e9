"""The search corpus: built from chunks and short documents, then kept up to date.

Parquet has no in-place update. Each update returns the new corpus as a DataFrame; write it to a new
folder and point readers there.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semcorpus.functions.text import extract, file_format
from semcorpus.functions.vectors import has_vector, hash_embed
from semcorpus.operators.chunk import chunk_fixed, is_long
from semcorpus.operators.ingest import EXTRACTED
from semcorpus.settings import DEFAULTS
from semcorpus.sources.tables import on_days


def parent_id(doc_id: Column | str) -> Column:
    return F.split(doc_id, ":")[0]


def not_chunked(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents without chunks. Parents are made distinct map-side before the join shuffles them."""
    parents = chunks.select(parent_id("doc_id").alias("doc_id")).distinct()
    return documents.join(parents, "doc_id", "left_anti").select(documents.columns)


def search_corpus(documents: DataFrame, chunks: DataFrame, size: int = DEFAULTS.chunk_size) -> DataFrame:
    """All chunks, and the short documents that have none."""
    short = documents.where(F.col("text_content").isNotNull() & ~is_long("text_content", size))
    return chunks.unionByName(not_chunked(short, chunks), allowMissingColumns=True)


def build_corpus(documents: DataFrame, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap):
    """Chunk and assemble in one go. A document is long or short, so no join is needed."""
    chunks = chunk_fixed(documents, size, overlap)
    short = documents.where(F.col("text_content").isNotNull() & ~is_long("text_content", size))
    return chunks.unionByName(short, allowMissingColumns=True)


def add_missing(corpus: DataFrame, documents: DataFrame, modality: str, key: str = "doc_id") -> DataFrame:
    """The documents of a modality that the corpus lacks, ready to append."""
    present = corpus.where(F.col("modality") == modality).select(key).where(F.col(key).isNotNull())
    wanted = documents.where(F.col("modality") == modality)
    return wanted.join(present.distinct(), key, "left_anti").select(documents.columns)


def write_embeddings(corpus: DataFrame, fresh: DataFrame) -> DataFrame:
    """Take the new vector of (doc_id, embedding) where there is one."""
    new = fresh.select("doc_id", F.col("embedding").alias("__new"))
    return (
        corpus.join(new, "doc_id", "left")
        .withColumn("embedding", F.coalesce("__new", "embedding"))
        .select(corpus.columns)
    )


def set_embedding(corpus: DataFrame, doc_id: str, vector: list[float]) -> DataFrame:
    """One row's vector: a CASE on the key, no join."""
    value = F.lit([float(x) for x in vector]).cast("array<double>")
    return corpus.withColumn(
        "embedding", F.when(F.col("doc_id") == doc_id, value).otherwise(F.col("embedding"))
    )


def clear_embeddings(corpus: DataFrame) -> DataFrame:
    return corpus.withColumn("embedding", F.lit(None).cast("array<double>"))


def fix_empty(corpus: DataFrame) -> DataFrame:
    """Empty vectors become NULL."""
    return corpus.withColumn("embedding", F.when(F.size("embedding") > 0, F.col("embedding")))


def fix_dims(corpus: DataFrame, dim: int = DEFAULTS.dim) -> DataFrame:
    """Vectors of the wrong size become NULL; empty ones are left to fix_empty."""
    n = F.size("embedding")
    return corpus.withColumn("embedding", F.when(~((n > 0) & (n != dim)), F.col("embedding")))


def needs_embedding() -> Column:
    return ~has_vector("embedding") & (F.length("text_content") > 0)


def embed_backfill(
    corpus: DataFrame, dim: int = DEFAULTS.dim, embed=None, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """Embed every row that lacks a vector and has text, in one pass without a join.

    embed maps a text column to a vector column; rows that already have a vector send it a NULL text. start and end
    name the days to return: of a table kept by day only their folders are read. A filter on the result would run
    after the vectors are made.
    """
    corpus = on_days(corpus, start, end)
    text = F.when(needs_embedding(), F.col("text_content"))
    made = hash_embed(text, dim) if embed is None else embed(text)
    return corpus.withColumn("__made", made).withColumn(
        "embedding", F.coalesce("__made", "embedding")
    ).drop("__made")


def repair_embeddings(
    corpus: DataFrame, dim: int = DEFAULTS.dim, embed=None, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """Drop empty and wrong-sized vectors, then embed what is missing; days as in embed_backfill."""
    return embed_backfill(fix_dims(fix_empty(corpus), dim), dim, embed, start, end)


def pending(corpus: DataFrame, n: int = 1000) -> DataFrame:
    """The newest n rows that need a vector."""
    return (
        corpus.where(needs_embedding())
        .select("doc_id", "text_content", F.length("text_content").alias("text_length"), "created_at")
        .orderBy(F.col("created_at").desc(), "doc_id")
        .limit(n)
    )


def sync_text(corpus: DataFrame, documents: DataFrame, modality: str = "pdf") -> DataFrame:
    """Copy the text of documents that carry extracted text into the corpus."""
    done = documents.where(
        (F.col("modality") == modality) & F.contains("text_content", F.lit(EXTRACTED))
    ).select("doc_id", F.col("text_content").alias("__text"))
    return (
        corpus.join(done, "doc_id", "left")
        .withColumn("text_content", F.coalesce("__text", "text_content"))
        .select(corpus.columns)
    )


def replace_text(corpus: DataFrame, texts: DataFrame, reset: bool = True) -> DataFrame:
    """New text by uri; with reset the vector is dropped so that it is made again."""
    new = texts.select("uri", F.col("text_content").alias("__text"), F.lit(True).alias("__hit"))
    joined = corpus.join(new, "uri", "left")
    hit = F.coalesce("__hit", F.lit(False))
    joined = joined.withColumn("text_content", F.when(hit, F.col("__text")).otherwise(F.col("text_content")))
    if reset:
        joined = joined.withColumn("embedding", F.when(~hit, F.col("embedding")))
    return joined.select(corpus.columns)


def describe_images(corpus: DataFrame, descriptions: DataFrame, objects: DataFrame, indexed: Column) -> DataFrame:
    """Rebuild the text of described images from description, tags, format, size and type."""
    d = descriptions.join(objects.select("uri", "size", "content_type"), "uri").select(
        "uri", F.col("description").alias("__d"), F.col("tags").alias("__t"),
        F.col("size").alias("__s"), F.col("content_type").alias("__c"), F.lit(True).alias("__hit"),
    )
    text = F.concat(
        F.lit("Image: "), extract("uri", r"/([^/]+)$"),
        F.lit("\n\nDescription: "), F.col("__d"),
        F.lit("\n\nTags: "), F.array_join("__t", ", "),
        F.lit("\nFormat: "), file_format("uri"),
        F.lit("\nSize: "), F.col("__s").cast("string"),
        F.lit(" bytes\nType: "), F.col("__c"),
        F.lit("\n\nIndexed: "), indexed,
    )
    hit = F.coalesce("__hit", F.lit(False)) & (F.col("modality") == "image")
    return (
        corpus.join(d, "uri", "left")
        .withColumn("text_content", F.when(hit, text).otherwise(F.col("text_content")))
        .select(corpus.columns)
    )
