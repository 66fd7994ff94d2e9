"""Reports over search results. Inputs hold k rows per query, so grouping them is cheap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semcorpus.functions.text import file_name, head, token_estimate

# Labels of media types and of coverage grades.
ICONS = {"pdf": "📄", "video": "🎥", "audio": "🎙️", "images": "🖼️"}
OTHER_ICON = "📝"
GRADES = ("❌ No coverage", "⚠️ Weak coverage", "✅ Good coverage", "🌟 Excellent coverage")
RULE = "\n---\n"


def media_icon(source: str = "source") -> Column:
    out = F
    for name, icon in ICONS.items():
        out = out.when(F.col(source) == name, icon)
    return out.otherwise(OTHER_ICON)


def confidence(score: str = "relevance_score") -> Column:
    return F.round(F.col(score) * 100, 1)


def with_first(df: DataFrame, by: str, n: int, value: Column, name: str, *stats: Column) -> DataFrame:
    """Per group its statistics and an ordered array of its n best values, in one pass over the hits."""
    w = Window.partitionBy(by).orderBy(*_best_first())
    numbered = df.withColumn("__n", F.row_number().over(w))
    best = F.array_sort(F.collect_list(F.when(F.col("__n") <= n, F.struct("__n", value.alias("v")))))
    return numbered.groupBy(by).agg(*stats, F.transform(best, lambda s: s["v"]).alias(name))


def _best_first() -> list[Column]:
    return [F.col("relevance_score").desc(), F.col("distance"), F.col("doc_id")]


def batch_summary(results: DataFrame) -> DataFrame:
    """Per query: hits, mean and best relevance, sources, start of the best text."""
    best = F.struct("relevance_score", -F.col("distance"), "doc_id")
    return results.groupBy(F.col("query_id").alias("topic")).agg(
        F.count(F.lit(1)).alias("document_count"),
        F.round(F.avg("relevance_score"), 3).alias("avg_relevance"),
        F.round(F.max("relevance_score"), 3).alias("best_match_score"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        head(F.max_by("text_content", best), 200).alias("top_result_preview"),
    )


def explore_by_source(results: DataFrame, n: int = 3) -> DataFrame:
    """Per source: icon, hits, mean relevance, its n best hits."""
    value = F.struct(
        file_name("uri").alias("filename"), "relevance_score", head("text_content", 200).alias("preview")
    )
    return with_first(
        results, "source", n, value, "top_results",
        F.count(F.lit(1)).alias("count"), F.round(F.avg("relevance_score"), 2).alias("avg_relevance"),
    ).select(media_icon().alias("icon"), F.col("source").alias("media_type"), "count", "avg_relevance", "top_results")


def daily_mentions(results: DataFrame, n: int = 3) -> DataFrame:
    """Per day: hits, mean relevance, its n best hits."""
    return with_first(
        results.withColumn("date", F.to_date("created_at")), "date", n,
        F.struct(file_name("uri").alias("filename"), "relevance_score"), "top_documents",
        F.count(F.lit(1)).alias("daily_mentions"), F.round(F.avg("relevance_score"), 3).alias("avg_relevance"),
    )


def top_files_by_source(results: DataFrame, n: int = 5) -> DataFrame:
    return with_first(results, "source", n, file_name("uri"), "top_files", F.count(F.lit(1)).alias("count"))


def coverage(topics: DataFrame, results: DataFrame, depth: int = 20) -> DataFrame:
    """Per topic: hits, mean relevance of the nearest hits up to depth, and a grade. rank counts from 1."""
    stats = results.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("matches"),
        F.avg(F.when(F.col("rank") <= depth, F.col("relevance_score"))).alias("avg_score"),
    )
    matches = F.coalesce("matches", F.lit(0))
    score = F.col("avg_score")
    return topics.select("query_id").join(stats, "query_id", "left").select(
        F.col("query_id").alias("topic"),
        matches.alias("matches"),
        F.round(score, 3).alias("avg_relevance"),
        F.when(matches == 0, GRADES[0]).when(score < 0.7, GRADES[1]).when(score < 0.85, GRADES[2])
        .otherwise(GRADES[3]).alias("status"),
    )


def knowledge_gaps(topics: DataFrame, results: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Topics without hits, or whose mean relevance is below the threshold."""
    stats = results.groupBy("query_id").agg(F.avg("relevance_score").alias("avg_relevance"))
    return (
        topics.select("query_id").join(stats, "query_id", "left")
        .where(F.col("avg_relevance").isNull() | (F.col("avg_relevance") < threshold))
        .select(F.col("query_id").alias("topic"), "avg_relevance")
    )


def topic_coverage(topics: DataFrame, results: DataFrame) -> DataFrame:
    """Per topic: hits, mean relevance, hits per source as a map, start of the best text."""
    per_source = results.groupBy("query_id", "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("relevance_score").alias("s"),
        F.max(F.struct("relevance_score", -F.col("distance"), "doc_id", head("text_content", 200).alias("t"))).alias("b"),
    )
    stats = per_source.groupBy("query_id").agg(
        F.sum("n").alias("document_count"),
        (F.sum("s") / F.sum("n")).alias("avg_relevance"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("source_distribution"),
        F.max("b")["t"].alias("top_match"),
    )
    return topics.select("query_id").join(stats, "query_id", "left").select(
        F.col("query_id").alias("topic"),
        F.coalesce("document_count", F.lit(0)).alias("document_count"),
        F.coalesce("avg_relevance", F.lit(0.0)).alias("avg_relevance"),
        "source_distribution",
        F.coalesce("top_match", F.lit("No results")).alias("top_match"),
    )


def compare_queries(topics: DataFrame, results: DataFrame) -> DataFrame:
    stats = results.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("count"), F.avg("relevance_score").alias("avg_score"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    )
    return topics.select("query_id").join(stats, "query_id", "left").select(
        "query_id", F.coalesce("count", F.lit(0)).alias("count"),
        F.coalesce("avg_score", F.lit(0.0)).alias("avg_score"), "sources",
    )


def result_profile(results: DataFrame) -> DataFrame:
    """Per source: hits, mean, least and greatest score; a last row with a NULL source for all."""
    score = F.col("relevance_score")
    return results.rollup("source").agg(
        F.count(F.lit(1)).alias("count"), F.avg(score).alias("mean_score"), F.stddev(score).alias("std_score"),
        F.min(score).alias("min_score"), F.max(score).alias("max_score"),
        F.countDistinct("source").alias("sources"),
    )


# --- context for generation --------------------------------------------------------------------------


def _header() -> Column:
    return F.concat(F.lit("[Source: "), F.col("source"), F.lit(" - "), file_name("uri"), F.lit("]\n"))


def with_query(results: DataFrame, query_id: str = "") -> DataFrame:
    return results if "query_id" in results.columns else results.withColumn("query_id", F.lit(query_id))


def running_tokens(results: DataFrame) -> DataFrame:
    """Tokens so far by relevance; rows of equal relevance count together."""
    w = Window.partitionBy("query_id").orderBy(F.col("relevance_score").desc())
    return with_query(results).withColumn("running_tokens", F.sum(token_estimate("text_content")).over(w))


def _joined(df: DataFrame, part: Column, glue: str) -> DataFrame:
    return df.groupBy("query_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("__at", part.alias("p")))), lambda s: s["p"]), glue
        ).alias("context")
    )


def _numbered(results: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*_best_first())
    return with_query(results).withColumn("__at", F.row_number().over(w))


def rag_context(results: DataFrame, max_tokens: int = 2000) -> DataFrame:
    """Headed texts, best first, while the running token count stays within the budget."""
    kept = running_tokens(_numbered(results)).where(F.col("running_tokens") <= max_tokens)
    return _joined(kept, F.concat(_header(), F.col("text_content"), F.lit(RULE)), "\n")


def rag_context_truncating(results: DataFrame, max_tokens: int = 2000) -> DataFrame:
    """As rag_context, but the first text over the budget is cut to fill it, without a header."""
    w = Window.partitionBy("query_id").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    n = token_estimate("text_content", whole=True)
    held = _numbered(results).withColumn("__before", F.coalesce(F.sum(n).over(w), F.lit(0)))
    left = F.lit(max_tokens) - F.col("__before")
    whole = n <= left
    # Rows past the first overflow start beyond the budget, or repeat its overflow.
    kept = held.withColumn("__over", F.max((~whole).cast("int")).over(w)).where(
        F.coalesce("__over", F.lit(0)) == 0
    )
    part = F.when(whole, F.concat(_header(), F.lit("\n"), F.col("text_content"), F.lit("\n" + RULE))).otherwise(
        F.substring("text_content", F.lit(1), (left * 4).cast("int"))
    )
    return _joined(kept, part, "\n")


def qa_bundle(results: DataFrame, question: str, n: int = 3) -> DataFrame:
    """Question, the n best texts, their sources with previews, and the top source."""
    best = _numbered(results).where(F.col("__at") <= n)
    rows = F.array_sort(
        F.collect_list(F.struct("__at", "uri", "relevance_score", "text_content", head("text_content", 200).alias("preview")))
    )
    return best.agg(rows.alias("r")).select(
        F.lit(question).alias("question"),
        F.transform("r", lambda s: s["text_content"]).alias("contexts"),
        F.transform("r", lambda s: F.struct(s["uri"].alias("uri"), s["relevance_score"].alias("score"), s["preview"].alias("preview"))).alias("sources"),
        F.try_element_at("r", F.lit(1))["uri"].alias("top_answer_source"),
    )
