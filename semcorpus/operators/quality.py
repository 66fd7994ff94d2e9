"""Corpus and embedding reports: plain grouped aggregates, one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semcorpus.functions.vectors import has_vector
from semcorpus.operators.corpus import needs_embedding, parent_id
from semcorpus.settings import DEFAULTS

# Report order of modalities, and the text that marks a completed analysis.
REPORT_ORDER = ["text", "image", "pdf", "json", "csv", "audio", "video"]
ANALYSIS_MARKS = {
    "image": ["Vision API"],
    "audio": ["Speech-to-Text"],
    "video": ["Video Intelligence"],
    "pdf": ["Document AI", "PyPDF2"],
}


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(0.0)


def modality_stats(documents: DataFrame) -> DataFrame:
    return documents.groupBy("modality", "source").agg(
        F.count(F.lit(1)).alias("document_count"),
        F.countDistinct("uri").alias("unique_files"),
        F.avg(F.length("text_content")).alias("avg_text_length"),
        F.max("created_at").alias("latest_update"),
    ).orderBy(F.col("document_count").desc(), "modality", "source")


def document_stats(documents: DataFrame) -> DataFrame:
    """Count and latest per modality and source, and a grand total row with NULL keys."""
    per = documents.groupBy("modality", "source").agg(
        F.count(F.lit(1)).alias("count"), F.max("created_at").alias("latest")
    )
    return per.groupingSets([["modality", "source"], []], "modality", "source").agg(
        F.sum("count").alias("count"), F.max("latest").alias("latest")
    )


def document_count(documents: DataFrame) -> int:
    return documents.count()


def chunk_stats(chunks: DataFrame) -> DataFrame:
    n = F.length("text_content")
    return chunks.agg(
        F.countDistinct(parent_id("doc_id")).alias("original_documents"),
        F.count(F.lit(1)).alias("total_chunks"),
        F.avg(n).alias("avg_chunk_size"), F.min(n).alias("min_chunk_size"), F.max(n).alias("max_chunk_size"),
        F.avg("chunk_index").alias("avg_chunk_index"),
    ).withColumn(
        "avg_chunks_per_doc",
        F.when(F.col("original_documents") > 0, F.col("total_chunks") / F.col("original_documents")),
    )


def embedding_stats(corpus: DataFrame) -> DataFrame:
    """Coverage among rows with text; an empty vector counts as missing."""
    return corpus.where(F.col("text_content").isNotNull()).agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.count_if(has_vector("embedding")).alias("documents_with_embeddings"),
        F.count_if(~has_vector("embedding")).alias("documents_without_embeddings"),
        F.avg(F.nullif(F.size("embedding"), F.lit(0))).alias("avg_embedding_dimension"),
    ).withColumn("coverage_percentage", _share(F.col("documents_with_embeddings"), F.col("total_documents")))


def validate_embeddings(corpus: DataFrame) -> DataFrame:
    """Missing vectors where text exists, range of sizes, and the verdicts."""
    n = F.when(F.col("embedding").isNotNull(), F.size("embedding"))
    checked = corpus.agg(
        F.count_if(F.col("embedding").isNull() & (F.length("text_content") > 0)).alias("missing"),
        F.min(n).alias("min_dim"), F.max(n).alias("max_dim"), F.avg(n).alias("avg_dim"),
    )
    mixed = F.coalesce(F.col("min_dim") != F.col("max_dim"), F.lit(False))
    return checked.withColumn("inconsistent", mixed).withColumn("valid", (F.col("missing") == 0) & ~mixed)


def _state(dim: int) -> dict[str, Column]:
    e = F.col("embedding")
    n = F.coalesce(F.size(e), F.lit(-1))
    return {
        "null_embeddings": F.count_if(e.isNull()),
        "empty_embeddings": F.count_if(n == 0),
        "valid_embeddings": F.count_if(n == dim),
        "wrong_dimension": F.count_if((n > 0) & (n != dim)),
    }


def diagnose_embeddings(corpus: DataFrame, dim: int = DEFAULTS.dim) -> DataFrame:
    state = _state(dim)
    return corpus.groupBy("modality").agg(
        F.count(F.lit(1)).alias("total_docs"),
        F.count_if(F.col("text_content").isNull()).alias("no_content"),
        *[c.alias(n) for n, c in state.items()],
    ).orderBy("modality")


def verify_embeddings(corpus: DataFrame, dim: int = DEFAULTS.dim) -> DataFrame:
    state = _state(dim)
    text = F.col("text_content").isNotNull()
    return corpus.agg(
        F.count(F.lit(1)).alias("total_docs"),
        F.count_if(text).alias("has_content"),
        state["valid_embeddings"].alias("valid_embeddings"),
        F.count_if(text & F.col("embedding").isNull()).alias("missing_embeddings"),
        state["empty_embeddings"].alias("empty_embeddings"),
        state["wrong_dimension"].alias("wrong_dimension"),
    ).withColumn(
        "passed",
        (F.col("empty_embeddings") == 0) & (F.col("wrong_dimension") == 0) & (F.col("missing_embeddings") == 0)
        & (F.col("valid_embeddings") == F.col("has_content")),
    )


def analysed() -> Column:
    """Has the modality's analysis been run on this row."""
    text = F.col("text_content")
    out = F
    for modality, marks in ANALYSIS_MARKS.items():
        hit = F.contains(text, F.lit(marks[0]))
        for mark in marks[1:]:
            hit = hit | F.contains(text, F.lit(mark))
        out = out.when((F.col("modality") == modality) & hit, True)
    return (
        out.when(F.col("modality").isin("text", "markdown"), True)
        .when(F.col("modality").isin("json", "csv") & text.isNotNull(), True)
        .otherwise(False)
    )


def report_rank() -> Column:
    out = F
    for i, m in enumerate(REPORT_ORDER, 1):
        out = out.when(F.col("modality") == m, i)
    return out.otherwise(len(REPORT_ORDER) + 1)


def status_report(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("modality").agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(has_vector("embedding")).alias("has_embedding"),
        F.count_if(F.col("text_content").isNotNull()).alias("searchable"),
        F.count_if(analysed()).alias("full_analysis"),
    ).withColumn("report_rank", report_rank()).orderBy("report_rank", "modality")


def text_split(corpus: DataFrame) -> DataFrame:
    return corpus.where(F.col("modality") == "text").agg(
        F.count_if(F.endswith(F.col("uri"), F.lit(".txt"))).alias("text_count"),
        F.count_if(F.endswith(F.col("uri"), F.lit(".md"))).alias("markdown_count"),
        F.count(F.lit(1)).alias("total_text"),
    )


def corpus_totals(corpus: DataFrame) -> DataFrame:
    return corpus.agg(
        F.count(F.lit(1)).alias("total_docs"),
        F.count_if(has_vector("embedding")).alias("total_embedded"),
        F.count_if(F.col("text_content").isNotNull()).alias("total_searchable"),
    )


def data_status(corpus: DataFrame) -> DataFrame:
    return corpus.agg(
        F.count(F.lit(1)).alias("total_docs"),
        F.countDistinct("modality").alias("modalities"),
        F.countDistinct("source").alias("sources"),
        F.count_if(has_vector("embedding")).alias("with_embeddings"),
    ).withColumn("embedding_pct", _share(F.col("with_embeddings"), F.col("total_docs")))


def description_coverage(corpus: DataFrame) -> DataFrame:
    return corpus.where(F.col("modality") == "image").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.contains("text_content", F.lit("Description:"))).alias("with_descriptions"),
    ).withColumn("without_descriptions", F.col("total") - F.col("with_descriptions")).withColumn(
        "percent", _share(F.col("with_descriptions"), F.col("total"))
    )


def missing_by_modality(corpus: DataFrame) -> DataFrame:
    """Rows with text and no vector, per modality that has any."""
    todo = corpus.where(F.col("text_content").isNotNull() & ~has_vector("embedding"))
    return todo.groupBy("modality").agg(F.count(F.lit(1)).alias("needs_embedding")).orderBy("modality")


def wrong_dims_by_modality(corpus: DataFrame, dim: int = DEFAULTS.dim) -> DataFrame:
    wrong = corpus.where(has_vector("embedding") & ~has_vector("embedding", dim))
    return wrong.groupBy("modality").agg(F.count(F.lit(1)).alias("count")).orderBy("modality")


def run_stats(documents: DataFrame) -> DataFrame:
    """Per modality of one ingest: documents, rows whose text could not be read, files; then the totals."""
    return documents.rollup("modality").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("text_content").isNull()).alias("errors"),
        F.countDistinct("uri").alias("files"),
    )


def pending_count(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.count_if(needs_embedding()).alias("pending"))
