"""Retrieval analytics and quality reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from semcorpus.operators import analytics as a, quality as q, search as s
from semcorpus.plans import inputs as i
from semcorpus.plans.inputs import CORPUS, DIRTY, DOCS, stamp_sql
from semcorpus.plans.registry import query
from semcorpus.plans.search_plans import BATCH, NEAR, POOLED, batch

HITS = f"""{NEAR}, hits AS (SELECT *, round(1 - distance, 3) AS relevance_score,
    regexp_extract(uri, '([^/]+)$', 1) AS filename FROM ({POOLED}) WHERE rn <= 60)"""


def hits(spark, sf, k=60):
    return s.semantic_search(i.corpus(spark, sf), i.topic(spark, sf), k)


def show(c, **parts):
    """An array of structs as text."""
    return F.array_join(F.transform(c, lambda x: F.concat_ws("|", *[f(x) for f in parts.values()])), ";")


def score(x):
    return F.format_string("%.3f", x["relevance_score"])


@query("batch_summary", f"""WITH {BATCH} SELECT query_id AS topic, count(*) AS document_count,
    round(avg(relevance_score), 3) AS avg_relevance, round(max(relevance_score), 3) AS best_match_score,
    string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
    substr(first(text_content ORDER BY relevance_score DESC, distance, doc_id DESC), 1, 200) AS top_result_preview
    FROM batch WHERE rank <= 5 AND 1 - distance >= 0.3 GROUP BY query_id""")
def batch_summary(spark, sf):
    return a.batch_summary(batch(spark, sf, 5, 0.3)).withColumn("sources", F.array_join("sources", ","))


@query("explore_by_source", f"""WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY source
    ORDER BY relevance_score DESC, distance, doc_id) AS nth FROM hits) SELECT '📝' AS icon, source AS media_type,
    count(*) AS count, round(avg(relevance_score), 2) AS avg_relevance,
    string_agg(filename || '|' || printf('%.3f', relevance_score) || '|' || substr(text_content, 1, 200), ';' ORDER BY nth)
    FILTER (nth <= 3) AS top_results FROM r GROUP BY source""")
def explore_by_source(spark, sf):
    found = a.explore_by_source(hits(spark, sf))
    return found.withColumn("top_results", show(
        "top_results", f=lambda x: x["filename"], s=score, p=lambda x: x["preview"]
    ))


@query("daily_mentions", f"""WITH {HITS}, r AS (SELECT *, CAST(created_at AS DATE) AS d, row_number() OVER (
    PARTITION BY CAST(created_at AS DATE) ORDER BY relevance_score DESC, distance, doc_id) AS nth FROM hits
    WHERE CAST(created_at AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-18')
    SELECT CAST(d AS VARCHAR) AS day, count(*) AS daily_mentions, round(avg(relevance_score), 3) AS avg_relevance,
    string_agg(filename || '|' || printf('%.3f', relevance_score), ';' ORDER BY nth) FILTER (nth <= 3) AS top_documents
    FROM r GROUP BY d""")
def daily_mentions(spark, sf):
    found = s.search_by_date(i.corpus(spark, sf), i.topic(spark, sf), date(2024, 1, 2), date(2024, 1, 18), 60)
    days = a.daily_mentions(found)
    return days.select(
        F.col("date").cast("string").alias("day"), "daily_mentions", "avg_relevance",
        show("top_documents", f=lambda x: x["filename"], s=score).alias("top_documents"),
    )


@query("top_files_by_source", f"""WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY source
    ORDER BY relevance_score DESC, distance, doc_id) AS nth FROM hits) SELECT source, count(*) AS count,
    string_agg(filename, ',' ORDER BY nth) FILTER (nth <= 5) AS top_files FROM r GROUP BY source""")
def top_files_by_source(spark, sf):
    return a.top_files_by_source(hits(spark, sf)).withColumn("top_files", F.array_join("top_files", ","))


@query("coverage", f"""WITH {BATCH}, g AS (SELECT query_id, count(*) AS matches,
    avg(relevance_score) FILTER (rank <= 20) AS s FROM batch WHERE rank <= 100 AND 1 - distance >= 0.36 GROUP BY query_id)
    SELECT t.query_id AS topic, coalesce(matches, 0) AS matches, round(s, 3) AS avg_relevance,
    CASE WHEN coalesce(matches, 0) = 0 THEN '❌ No coverage' WHEN s < 0.7 THEN '⚠️ Weak coverage'
    WHEN s < 0.85 THEN '✅ Good coverage' ELSE '🌟 Excellent coverage' END AS status
    FROM topics t LEFT JOIN g ON g.query_id = t.query_id""")
def coverage(spark, sf):
    return a.coverage(i.topics(spark, sf), batch(spark, sf, 100, 0.36))


@query("knowledge_gaps", f"""WITH {BATCH}, g AS (SELECT query_id, avg(relevance_score) AS s FROM batch
    WHERE rank <= 5 AND 1 - distance >= 0.36 GROUP BY query_id) SELECT t.query_id AS topic, round(s, 6) AS avg_relevance
    FROM topics t LEFT JOIN g ON g.query_id = t.query_id WHERE s IS NULL OR s < 0.4""")
def knowledge_gaps(spark, sf):
    found = a.knowledge_gaps(i.topics(spark, sf), batch(spark, sf, 5, 0.36), 0.4)
    return found.withColumn("avg_relevance", F.round("avg_relevance", 6))


@query("topic_coverage", f"""WITH {BATCH}, b AS (SELECT * FROM batch WHERE rank <= 20 AND 1 - distance >= 0.36),
    per AS (SELECT query_id, source, count(*) AS n FROM b GROUP BY ALL),
    dist AS (SELECT query_id, string_agg(source || '=' || n, ',' ORDER BY source) AS d FROM per GROUP BY query_id),
    g AS (SELECT query_id, count(*) AS n, avg(relevance_score) AS s,
    substr(first(text_content ORDER BY relevance_score DESC, distance, doc_id DESC), 1, 200) AS t FROM b GROUP BY query_id)
    SELECT t.query_id AS topic, coalesce(n, 0) AS document_count, round(coalesce(s, 0), 6) AS avg_relevance,
    d AS source_distribution, coalesce(g.t, 'No results') AS top_match
    FROM topics t LEFT JOIN g ON g.query_id = t.query_id LEFT JOIN dist ON dist.query_id = t.query_id""")
def topic_coverage(spark, sf):
    found = a.topic_coverage(i.topics(spark, sf), batch(spark, sf, 20, 0.36))
    pairs = F.transform(F.map_entries("source_distribution"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return found.withColumns(
        {"avg_relevance": F.round("avg_relevance", 6), "source_distribution": F.array_join(pairs, ",")}
    )


@query("compare_queries", f"""WITH {BATCH} SELECT query_id, count(*) AS count, round(avg(relevance_score), 6) AS avg_score,
    string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM batch WHERE rank <= 5 GROUP BY query_id""")
def compare_queries(spark, sf):
    found = a.compare_queries(i.topics(spark, sf), batch(spark, sf, 5))
    return found.withColumns({"avg_score": F.round("avg_score", 6), "sources": F.array_join("sources", ",")})


@query("result_profile", f"""WITH {HITS} SELECT source, count(*) AS count, round(avg(relevance_score), 6) AS mean_score,
    round(stddev_samp(relevance_score), 6) AS std_score, min(relevance_score) AS min_score,
    max(relevance_score) AS max_score, count(DISTINCT source) AS sources FROM hits GROUP BY ROLLUP (source)""")
def result_profile(spark, sf):
    found = a.result_profile(hits(spark, sf))
    return found.withColumns({"mean_score": F.round("mean_score", 6), "std_score": F.round("std_score", 6)})


_HEAD = "'[Source: ' || source || ' - ' || regexp_extract(uri, '([^/]+)$', 1) || ']' || chr(10)"


@query("rag_context", f"""WITH {BATCH}, r AS (SELECT *, sum(length(text_content) / 4.0) OVER (PARTITION BY query_id
    ORDER BY relevance_score DESC) AS running FROM batch WHERE rank <= 15)
    SELECT query_id, string_agg({_HEAD} || text_content || chr(10) || '---' || chr(10), chr(10)
    ORDER BY relevance_score DESC, distance, doc_id) AS context FROM r WHERE running <= 4000 GROUP BY query_id""")
def rag_context(spark, sf):
    return a.rag_context(batch(spark, sf, 15), 4000)


@query("running_tokens", f"""WITH {BATCH} SELECT query_id, doc_id, round(sum(length(text_content) / 4.0) OVER (
    PARTITION BY query_id ORDER BY relevance_score DESC), 6) AS running_tokens FROM batch WHERE rank <= 15""")
def running_tokens(spark, sf):
    return a.running_tokens(batch(spark, sf, 15)).select(
        "query_id", "doc_id", F.round("running_tokens", 6).alias("running_tokens")
    )


@query("rag_context_truncating", f"""WITH {BATCH}, r AS (SELECT *, length(text_content) // 4 AS tok,
    coalesce(sum(length(text_content) // 4) OVER (PARTITION BY query_id ORDER BY relevance_score DESC, distance, doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM batch WHERE rank <= 10),
    o AS (SELECT *, min(CASE WHEN tok > 2000 - before THEN rank END) OVER (PARTITION BY query_id) AS first_over FROM r)
    SELECT query_id, string_agg(CASE WHEN tok <= 2000 - before
    THEN {_HEAD} || chr(10) || text_content || chr(10) || chr(10) || '---' || chr(10)
    ELSE substr(text_content, 1, CAST((2000 - before) * 4 AS BIGINT)) END, chr(10) ORDER BY rank) AS context
    FROM o WHERE rank <= coalesce(first_over, 1000) GROUP BY query_id""")
def rag_context_truncating(spark, sf):
    return a.rag_context_truncating(batch(spark, sf, 10), 2000)


@query("qa_bundle", f"""WITH {HITS}, r AS (SELECT *, row_number() OVER (ORDER BY relevance_score DESC, distance, doc_id)
    AS nth FROM hits) SELECT 'what is this about?' AS question, string_agg(text_content, '§' ORDER BY nth) AS contexts,
    string_agg(uri || '|' || printf('%.3f', relevance_score) || '|' || substr(text_content, 1, 200), '§' ORDER BY nth) AS sources,
    first(uri ORDER BY nth) AS top_answer_source FROM r WHERE nth <= 3""")
def qa_bundle(spark, sf):
    found = a.qa_bundle(hits(spark, sf), "what is this about?", 3)
    lines = F.transform(
        "sources", lambda x: F.concat_ws("|", x["uri"], F.format_string("%.3f", x["score"]), x["preview"])
    )
    return found.withColumns({"contexts": F.array_join("contexts", "§"), "sources": F.array_join(lines, "§")})


@query("confidence", f"WITH {HITS} SELECT doc_id, '📝' AS icon, round(relevance_score * 100, 1) AS confidence FROM hits")
def confidence(spark, sf):
    return hits(spark, sf).select("doc_id", a.media_icon().alias("icon"), a.confidence().alias("confidence"))


# --- quality -----------------------------------------------------------------------------------------


@query("modality_stats", f"""WITH {DOCS} SELECT modality, source, count(*) AS document_count,
    count(DISTINCT uri) AS unique_files, round(avg(length(text_content)), 6) AS avg_text_length,
    {stamp_sql('max(created_at)')} AS latest_update FROM docs GROUP BY modality, source""")
def modality_stats(spark, sf):
    return q.modality_stats(i.documents(spark, sf)).withColumns(
        {"avg_text_length": F.round("avg_text_length", 6), "latest_update": i.stamp("latest_update")}
    )


@query("document_stats", f"""WITH {DOCS} SELECT modality, source, count(*) AS count, {stamp_sql('max(created_at)')} AS latest
    FROM docs GROUP BY GROUPING SETS ((modality, source), ())""")
def document_stats(spark, sf):
    return q.document_stats(i.documents(spark, sf)).withColumn("latest", i.stamp("latest"))


@query("embedding_stats", f"""WITH {DIRTY}, t AS (SELECT count(*) AS n, count(*) FILTER (coalesce(len(embedding), 0) > 0) AS w,
    avg(nullif(len(embedding), 0)) AS d FROM dirty WHERE text_content IS NOT NULL) SELECT n AS total_documents,
    w AS documents_with_embeddings, n - w AS documents_without_embeddings, round(d, 6) AS avg_embedding_dimension,
    round(w / n * 100, 6) AS coverage_percentage FROM t""")
def embedding_stats(spark, sf):
    stats = q.embedding_stats(i.dirty(spark, sf))
    return stats.withColumns({x: F.round(x, 6) for x in ("avg_embedding_dimension", "coverage_percentage")})


@query("validate_embeddings", f"""WITH {DIRTY}, t AS (SELECT count(*) FILTER (embedding IS NULL AND length(text_content) > 0)
    AS missing, CAST(min(len(embedding)) AS INT) AS min_dim, CAST(max(len(embedding)) AS INT) AS max_dim,
    round(avg(len(embedding)), 6) AS avg_dim FROM dirty)
    SELECT *, min_dim <> max_dim AS inconsistent, missing = 0 AND min_dim = max_dim AS valid FROM t""")
def validate_embeddings(spark, sf):
    return q.validate_embeddings(i.dirty(spark, sf)).withColumn("avg_dim", F.round("avg_dim", 6))


_STATE = """count(*) FILTER (len(embedding) = 0) AS empty_embeddings,
    count(*) FILTER (len(embedding) = 64) AS valid_embeddings,
    count(*) FILTER (len(embedding) > 0 AND len(embedding) <> 64) AS wrong_dimension"""


@query("diagnose_embeddings", f"""WITH {DIRTY} SELECT modality, count(*) AS total_docs,
    count(*) FILTER (text_content IS NULL) AS no_content, count(*) FILTER (embedding IS NULL) AS null_embeddings,
    {_STATE} FROM dirty GROUP BY modality""")
def diagnose_embeddings(spark, sf):
    return q.diagnose_embeddings(i.dirty(spark, sf), i.DIM)


@query("verify_embeddings", f"""WITH {DIRTY} SELECT count(*) AS total_docs, count(text_content) AS has_content,
    count(*) FILTER (text_content IS NOT NULL AND embedding IS NULL) AS missing_embeddings, {_STATE}, false AS passed
    FROM dirty""")
def verify_embeddings(spark, sf):
    return q.verify_embeddings(i.dirty(spark, sf), i.DIM)


@query("status_report", f"""WITH {DIRTY} SELECT modality, count(*) AS count,
    count(*) FILTER (len(embedding) > 0) AS has_embedding, count(text_content) AS searchable,
    count(*) FILTER (CASE WHEN modality = 'image' THEN text_content LIKE '%Vision API%' WHEN modality = 'pdf'
    THEN text_content LIKE '%Document AI%' OR text_content LIKE '%PyPDF2%' ELSE true END) AS full_analysis,
    CASE modality WHEN 'text' THEN 1 WHEN 'image' THEN 2 WHEN 'pdf' THEN 3 ELSE 8 END AS report_rank
    FROM dirty GROUP BY modality""")
def status_report(spark, sf):
    return q.status_report(i.dirty(spark, sf))


@query("analysed_flags", """SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE doc_id % 4
    WHEN 0 THEN contains(text, 'Vision API') OR lang = 'en' WHEN 1 THEN lang = 'fr'
    WHEN 2 THEN lang = 'de' ELSE true END AS analysed FROM documents""")
def analysed_flags(spark, sf):
    """Texts marked by language as if analysed by the service of their modality."""
    n, lang = F.col("doc_id"), F.col("lang")
    d = i.table(spark, sf, "documents").select(
        n.cast("string").alias("doc_id"),
        i._pick(["image", "audio", "pdf", "json"], n % 4).alias("modality"),
        F.concat(
            "text",
            F.when(lang == "en", " Vision API").when(lang == "fr", " Speech-to-Text")
            .when(lang == "de", " PyPDF2").otherwise(""),
        ).alias("text_content"),
    )
    return d.select("doc_id", q.analysed().alias("analysed"))


@query("text_split", f"""WITH {CORPUS} SELECT count(*) FILTER (uri LIKE '%.txt') AS text_count,
    count(*) FILTER (uri LIKE '%.md') AS markdown_count, count(*) AS total_text FROM corpus WHERE modality = 'text'""")
def text_split(spark, sf):
    return q.text_split(i.documents(spark, sf))


@query("corpus_totals", f"""WITH {DIRTY} SELECT count(*) AS total_docs, count(*) FILTER (len(embedding) > 0) AS total_embedded,
    count(text_content) AS total_searchable FROM dirty""")
def corpus_totals(spark, sf):
    return q.corpus_totals(i.dirty(spark, sf))


@query("data_status", f"""WITH {DIRTY} SELECT count(*) AS total_docs, count(DISTINCT modality) AS modalities,
    count(DISTINCT source) AS sources, count(*) FILTER (len(embedding) > 0) AS with_embeddings,
    round(count(*) FILTER (len(embedding) > 0) / count(*) * 100, 6) AS embedding_pct FROM dirty""")
def data_status(spark, sf):
    return q.data_status(i.dirty(spark, sf)).withColumn("embedding_pct", F.round("embedding_pct", 6))


@query("missing_by_modality", f"""WITH {DIRTY} SELECT modality, count(*) AS needs_embedding FROM dirty
    WHERE text_content IS NOT NULL AND coalesce(len(embedding), 0) = 0 GROUP BY modality""")
def missing_by_modality(spark, sf):
    return q.missing_by_modality(i.dirty(spark, sf))


@query("pending_count", f"""WITH {DIRTY} SELECT count(*) FILTER (length(text_content) > 0
    AND coalesce(len(embedding), 0) = 0) AS pending FROM dirty""")
def pending_count(spark, sf):
    return q.pending_count(i.dirty(spark, sf))
