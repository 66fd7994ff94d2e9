"""Search entry points.

A filter runs after the nearest candidates are taken, as the reading of the API asks, so a filtered search
may return fewer than k rows. prefilter=True filters first and fills k.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, datetime
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semcorpus.functions.text import head, keyword_match, keyword_score, query_terms, tokens
from semcorpus.functions.vectors import hash_embed, hashed
from semcorpus.operators.knn import HIT_BYTES, knn, knn_join, load_centroids, probe_lists
from semcorpus.operators.list_index import ListIndex
from semcorpus.settings import DEFAULTS, MODALITY_ALIASES, Settings
from semcorpus.sources.tables import on_days

RESULT = ["doc_id", "uri", "modality", "source", "created_at", "author", "channel", "distance", "rel_score",
          "text_content"]
EPOCH = datetime(1970, 1, 1)


@lru_cache(maxsize=4096)
def _embedded(text: str, dim: int) -> tuple[float, ...]:
    vector = hashed(pa.array([text], pa.string()), dim)[0].as_py()
    if vector is None:
        raise ValueError("the query text has no tokens")
    return tuple(vector)


def query_vector(query: str | Sequence[float], dim: int = DEFAULTS.dim) -> Sequence[float]:
    """A vector as given, or the hashed vector of a text; texts are remembered."""
    return _embedded(query, dim) if isinstance(query, str) else query


# --- filters -----------------------------------------------------------------------------------------


def parse_day(value: str | date | datetime | None, default: datetime) -> datetime:
    """A YYYY-MM-DD day at midnight; the default when missing or malformed."""
    if isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    try:
        return datetime.strptime(value, "%Y-%m-%d") if value else default
    except ValueError:
        return default


def source_filter(sources: Sequence[str] | None) -> Column:
    return F.col("source").isin(list(sources)) if sources else F.lit(True)


def modality_filter(modalities: Sequence[str] | None) -> Column:
    """Either spelling of a modality selects rows of both."""
    if not modalities:
        return F.lit(True)
    names = list(modalities) + [MODALITY_ALIASES[m] for m in modalities if m in MODALITY_ALIASES]
    return F.col("modality").isin(sorted(set(names)))


def regex_filter(pattern: str | None) -> Column:
    return F.rlike("text_content", F.lit(pattern)) if pattern else F.lit(True)


def time_filter(start, end, now: datetime | None = None) -> Column:
    """created_at between two moments, both included; an end day counts up to its midnight."""
    if not start and not end:
        return F.lit(True)
    lo = parse_day(start, EPOCH)
    hi = parse_day(end, now or datetime.now())
    return F.col("created_at").between(F.lit(lo).cast("timestamp"), F.lit(hi).cast("timestamp"))


def day_filter(start: date, end: date) -> Column:
    """Whole days between two dates, both included."""
    return F.to_date("created_at").between(F.lit(start), F.lit(end))


def relevance(distance: Column | str = "distance") -> Column:
    return F.round(1 - F.col(distance) if isinstance(distance, str) else 1 - distance, 3)


def min_relevance(threshold: float | None) -> Column:
    """On the unrounded relevance."""
    return (1 - F.col("distance")) >= F.lit(float(threshold or 0.0))


# --- one query ---------------------------------------------------------------------------------------


def probed(spark: SparkSession, index: str | ListIndex, query: Sequence[float], probes: int) -> DataFrame:
    """The rows of an index in the lists nearest to the query; other folders are not read."""
    if isinstance(index, ListIndex):
        return index.rows(index.nearest_lists(query, probes))
    lists = probe_lists(load_centroids(spark, index), query, probes)
    return spark.read.parquet(f"{index}/rows").where(F.col("ivf_list").isin(lists))


def nearest(
    corpus: DataFrame, query: Sequence[float], k: int, index: str | ListIndex | None = None, probes: int | None = None,
    keep: Column | None = None, settings: Settings = DEFAULTS,
) -> DataFrame:
    """The k nearest rows with all their columns, in no order.

    Ranking reads ids and vectors (and what keep names). Only then are the other columns of the hits fetched, by id and by
    the folder columns, so that a partitioned table or an index is read in the folders of the hits alone.
    """
    rows = corpus if index is None else probed(corpus.sparkSession, index, query, probes or settings.probes)
    held = rows if keep is None else rows.where(keep)
    keys = ["doc_id", *[c for c in ("created_date", "ivf_list", "part") if c in rows.columns]]
    # The bound on the distance holds for all; it tells Spark that the hits are few, which lets it skip folders.
    near = knn(held.select(*keys, "embedding"), query, k).select(*keys, "distance").where("distance <= 2")
    return rows.join(F.broadcast(near) if k * HIT_BYTES <= settings.broadcast_bytes else near, keys)


def _rows(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select(*[c if c in have else F.lit(None).cast("double").alias(c) for c in RESULT])


def search(
    corpus: DataFrame, query: str | Sequence[float], k: int = DEFAULTS.top_k, *,
    sources=None, modalities=None, regex: str | None = None, start=None, end=None, now: datetime | None = None,
    candidates: int | None = None, prefilter: bool = False, index: str | None = None, probes: int | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Over-fetch, filter, then the k nearest; with an index, among the lists nearest to the query."""
    q = query_vector(query, settings.dim)
    keep = source_filter(sources) & modality_filter(modalities) & regex_filter(regex) & time_filter(start, end, now)
    if prefilter:
        rows = corpus
        if start or end:
            rows = on_days(corpus, parse_day(start, EPOCH), parse_day(end, now or datetime.now()))
        return _rows(nearest(rows, q, k, index, probes, keep, settings).orderBy("distance", "doc_id"))
    pool = nearest(corpus, q, candidates or k * settings.search_multiplier, index, probes, settings=settings)
    return _rows(pool.where(keep).orderBy("distance", "doc_id").limit(k))


def semantic_search(
    corpus, query, k: int | None = 10, threshold: float | None = 0.0, settings: Settings = DEFAULTS,
    index: str | None = None, probes: int | None = None,
) -> DataFrame:
    """k nearest rows above a relevance, with the rounded relevance."""
    many = DEFAULTS.top_k if k is None else k
    found = nearest(corpus, query_vector(query, settings.dim), many, index, probes, settings=settings)
    return (
        found.where(min_relevance(threshold))
        .select(
            "doc_id", "uri", "source", "modality", "text_content", relevance().alias("relevance_score"),
            "created_at", F.col("meta").alias("metadata"), "distance",
        )
        .orderBy("distance", "doc_id")
    )


def quick_search(corpus, query, settings: Settings = DEFAULTS, **index) -> DataFrame:
    return semantic_search(corpus, query, 10, 0.0, settings, **index)


def search_by_source(corpus, query, sources, k=10, settings: Settings = DEFAULTS, **index) -> DataFrame:
    return semantic_search(corpus, query, k, 0.0, settings, **index).where(F.col("source").isin(list(sources)))


def search_by_date(corpus, query, start: date, end: date, k=10, settings: Settings = DEFAULTS, **index) -> DataFrame:
    return semantic_search(corpus, query, k, 0.0, settings, **index).where(day_filter(start, end))


def search_content(corpus, query, n: int = 5, settings: Settings = DEFAULTS, **index) -> DataFrame:
    return semantic_search(corpus, query, n, 0.0, settings, **index).select("text_content")


def rerank_order() -> list[Column]:
    return [F.coalesce(F.col("rel_score"), F.lit(0.0)).desc(), F.col("distance"), F.col("doc_id")]


def semantic_grep_table(
    corpus, query, k, sources=None, start=None, end=None, regex=None, scorer: Column | None = None,
    now: datetime | None = None, settings: Settings = DEFAULTS, **index,
) -> DataFrame:
    """Larger pool, all filters, rerank order. Without a scorer there is no relevance score."""
    size = max(k * settings.search_multiplier, settings.pool_floor)
    pool = nearest(corpus, query_vector(query, settings.dim), size, settings=settings, **index)
    kept = pool.where(source_filter(sources) & time_filter(start, end, now) & regex_filter(regex))
    scored = kept.withColumn("rel_score", F.lit(None).cast("double") if scorer is None else scorer)
    return _rows(scored).orderBy(*rerank_order()).limit(k)


def semantic_grep(corpus, query, k, settings: Settings = DEFAULTS, **index) -> DataFrame:
    """Candidates by vector alone, joined back to the corpus, with a constant score of 0.5."""
    size = max(k * settings.search_multiplier, settings.pool_floor)
    rows = nearest(corpus, query_vector(query, settings.dim), size, settings=settings, **index)
    return _rows(rows.withColumn("rel_score", F.lit(0.5))).orderBy(*rerank_order()).limit(k)


def search_similar(corpus, doc_id: str, k: int = 10, settings: Settings = DEFAULTS, **index) -> DataFrame:
    """Neighbours of a stored document, without itself."""
    stored = corpus.where((F.col("doc_id") == doc_id) & F.col("embedding").isNotNull()).select("embedding").first()
    if stored is None:
        raise ValueError(f"no embedded document {doc_id!r}")
    near = nearest(corpus, stored["embedding"], k + 1, settings=settings, **index).where(F.col("doc_id") != doc_id)
    return (
        near.select("doc_id", "uri", "modality", "source", "created_at", "text_content", "distance")
        .orderBy("distance", "doc_id")
        .limit(k)
    )


def keyword_search(corpus, query: str, k: int) -> DataFrame:
    """Rows holding any term, by the share of terms they hold."""
    terms = query_terms(query)
    if not terms:
        raise ValueError("the query has no terms")
    return (
        corpus.where(keyword_match("text_content", terms))
        .withColumn("keyword_score", keyword_score("text_content", terms))
        .select("doc_id", "uri", "modality", "source", "created_at", "author", "channel", "text_content",
                "keyword_score")
        .orderBy(F.col("keyword_score").desc(), "doc_id")
        .limit(k)
    )


def hybrid_merge(semantic: DataFrame, keyword: DataFrame, keyword_weight: float = 0.3) -> DataFrame:
    """Full outer join on doc_id; a side without the document adds nothing."""
    shared = ["uri", "modality", "source", "created_at", "author", "channel", "text_content"]
    s, w = semantic.alias("s"), keyword.alias("w")
    score = (
        F.coalesce((1 - F.lit(keyword_weight)) / (1 + F.col("s.distance")), F.lit(0.0))
        + F.coalesce(F.lit(keyword_weight) * F.col("w.keyword_score"), F.lit(0.0))
    )
    return s.join(w, F.col("s.doc_id") == F.col("w.doc_id"), "full_outer").select(
        F.coalesce("s.doc_id", "w.doc_id").alias("doc_id"),
        *[F.coalesce(f"s.{c}", f"w.{c}").alias(c) for c in shared],
        F.col("s.distance").alias("distance"), F.col("w.keyword_score").alias("keyword_score"),
        score.alias("combined_score"),
    )


def hybrid_search(
    corpus, query, keywords: str | None = None, k: int = 20, keyword_weight: float = 0.3,
    settings: Settings = DEFAULTS, **index,
) -> DataFrame:
    """Weighted blend of 1/(1+distance) and the keyword score over two pools of 2k."""
    if keywords is None:
        if not isinstance(query, str):
            raise ValueError("give keywords with a vector query")
        keywords = query
    meant = search(corpus, query, 2 * k, settings=settings, **index)
    merged = hybrid_merge(meant, keyword_search(corpus, keywords, 2 * k), keyword_weight)
    return merged.orderBy(F.round("combined_score", 9).desc(), "doc_id").limit(k)


def term_coverage(query: str, text: Column | str = "text_content") -> Column:
    """Ten times the share of the query's distinct words among the words of the text."""
    wanted = F.array_distinct(tokens(F.lit(query)))
    return F.lit(10.0) * F.size(F.array_intersect(wanted, tokens(text))) / F.size(wanted)


def score_with(text: Column | str, model: Callable[[list[str]], Sequence[float]]) -> Column:
    """Score with a caller's model: a picklable function from texts to numbers, run per Arrow batch."""

    @F.arrow_udf("double")
    def model_scores(batch: pa.Array) -> pa.Array:
        rows = np.flatnonzero(np.asarray(batch.is_valid()))
        out: list[float | None] = [None] * len(batch)
        if len(rows):
            for r, found in zip(rows, model(batch.take(pa.array(rows)).to_pylist())):
                out[r] = float(found)
        return pa.array(out, pa.float64())

    return model_scores(F.col(text) if isinstance(text, str) else text)


def rerank(
    corpus, query, k: int = 10, scorer: Column | None = None, query_text: str | None = None,
    settings: Settings = DEFAULTS, **index,
) -> DataFrame:
    """Score 3k candidates on their first 1000 characters; best k.

    The scorer is a column over the candidates, such as score_with("snippet", model).
    """
    text = query if isinstance(query, str) else query_text
    if scorer is None and text is None:
        raise ValueError("give a scorer or the query text")
    pool = nearest(corpus, query_vector(query, settings.dim), 3 * k, settings=settings, **index)
    pool = pool.withColumn("snippet", head("text_content", 1000))
    score = term_coverage(text, "snippet") if scorer is None else scorer
    return (
        pool.withColumn("relevance_score", score)
        .select("doc_id", "uri", "modality", "source", "text_content", "distance", "relevance_score")
        .orderBy(F.col("relevance_score").desc(), "distance", "doc_id")
        .limit(k)
    )


def relevant_docs(
    corpus, query, threshold: float = 0.7, k: int = 10, settings: Settings = DEFAULTS, **index
) -> DataFrame:
    """Id, path and snippet of the hits above a relevance."""
    return search(corpus, query, k, settings=settings, **index).where((1 - F.col("distance")) > threshold).select(
        F.col("doc_id").alias("id"), F.col("uri").alias("path"), head("text_content", 200).alias("snippet")
    )


def format_results(results: DataFrame) -> DataFrame:
    """Score and content, with the remaining columns gathered in metadata."""
    named = ["doc_id", "uri", "source", "modality"]
    rest = [c for c in results.columns if c not in (*named, "rel_score", "distance", "text_content")]
    return results.select(
        *named,
        F.coalesce("rel_score", "distance").alias("score"),
        relevance().alias("relevance_score"),
        F.coalesce("text_content", F.lit("")).alias("content"),
        F.struct(*rest).alias("metadata"),
    )


# --- many queries ------------------------------------------------------------------------------------


def search_batch(
    corpus: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, dim: int = DEFAULTS.dim,
    settings: Settings = DEFAULTS, index: ListIndex | None = None, probes: int | None = None,
) -> DataFrame:
    """The k nearest rows of every (query_id, q), in one job, with the corpus columns joined on.

    With an index each query is compared with the rows of its `probes` nearest lists alone.
    """
    if index is None:
        hits = knn_join(queries, corpus, k, dim, settings=settings)
    else:
        hits = index.search_batch(queries, k, probes)
    if threshold is not None:
        hits = hits.where(min_relevance(threshold))
    rows = corpus.drop("embedding").join(hits, "doc_id")
    return rows.withColumn("relevance_score", relevance())


def text_queries(texts: DataFrame, id_col: str, text: str, dim: int) -> DataFrame:
    """(query_id, q) from a table of texts."""
    return texts.select(F.col(id_col).cast("string").alias("query_id"), hash_embed(text, dim).alias("q")).where(
        F.col("q").isNotNull()
    )
