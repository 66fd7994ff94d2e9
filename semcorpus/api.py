"""A client over a stored corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semcorpus.operators import search as s
from semcorpus.operators.knn import index_status
from semcorpus.operators.quality import document_stats
from semcorpus.settings import DEFAULTS, Settings


class SearchClient:
    """Search and statistics over documents, their corpus and, if built, its index.

    With an index, searches read only its lists nearest to the query: probes of them, or settings.probes.
    """

    def __init__(
        self, spark: SparkSession, corpus: DataFrame, documents: DataFrame | None = None, name: str = "corpus",
        index_path: str | None = None, probes: int | None = None, settings: Settings = DEFAULTS,
    ) -> None:
        self.spark, self.corpus, self.name = spark, corpus, name
        self.documents = corpus if documents is None else documents
        self.index_path, self.probes, self.settings = index_path, probes, settings

    def search(
        self, query: str | Sequence[float], top_k: int = 10, sources=None, rerank: bool = False,
        regex_filter: str | None = None, start_date=None, end_date=None, prefilter: bool = False, modalities=None,
    ) -> DataFrame:
        """Formatted hits. Without a model behind it, rerank orders the same hits by query-term coverage."""
        found = s.search(
            self.corpus, query, top_k, sources=sources, regex=regex_filter, start=start_date, end=end_date,
            prefilter=prefilter, modalities=modalities, index=self.index_path, probes=self.probes, settings=self.settings,
        )
        if rerank and isinstance(query, str):
            scored = s.term_coverage(query, s.head("text_content", 1000)) / 10
            found = found.withColumn("rel_score", scored).orderBy(*s.rerank_order())
        return s.format_results(found)

    def search_simple(self, query: str | Sequence[float], limit: int = 5) -> list[str]:
        """Only the contents of the best hits, at most limit of them."""
        rows = self.search(query, limit).select("content", "relevance_score").collect()
        return [r["content"] for r in rows]

    def stats(self) -> DataFrame:
        """One row: documents, latest, collection name and the state of the index."""
        total = document_stats(self.documents).where(F.col("modality").isNull() & F.col("source").isNull()).select(
            F.col("count").alias("document_count"), "latest", F.lit(self.name).alias("dataset_name")
        )
        if self.index_path is None:
            return total.withColumn("index_exists", F.lit(False))
        state = index_status(self.spark, self.index_path).first()
        return total.withColumns({
            "index_exists": F.lit(state["exists"]),
            "index_updated": F.lit(state["last_updated"]).cast("timestamp"),
            "index_rows": F.lit(state["rows"]),
        })

    def get_stats(self) -> dict:
        return self.stats().first().asDict()


def search(corpus: DataFrame, query: str | Sequence[float], top_k: int = 10, **options) -> DataFrame:
    """One search without keeping a client."""
    return SearchClient(corpus.sparkSession, corpus).search(query, top_k, **options)
