"""Queries on what is kept beside the corpus: the index that follows it, postings, updates by day, contexts in SQL."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from semcorpus.functions.text import tidy
from semcorpus.operators import corpus as c
from semcorpus.operators import knn
from semcorpus.operators import search as s
from semcorpus.operators.daily import DailyReports
from semcorpus.operators.known import drop_known
from semcorpus.operators.list_index import ListIndex
from semcorpus.operators.postings import Postings, build_postings
from semcorpus.plans import inputs as i
from semcorpus.plans.ingest_plans import _write_files
from semcorpus.plans.inputs import CORPUS, DIM, stamp_sql
from semcorpus.plans.registry import query
from semcorpus.plans.report_plans import _HEAD
from semcorpus.plans.search_plans import _LISTS, BATCH, HIT, KEYWORD, NEAR, PAIRS, POOLED, RE, TERMS, batch, hit
from semcorpus.settings import DEFAULTS
from semcorpus.sources.listing import list_objects
from semcorpus.sources.tables import read_table, write_table
from semcorpus.sources.updates import append_days, update_days
from semcorpus.sql_functions import register_sql, sql_vector

LISTS = 10


def built(spark, sf, rows=None):
    """The corpus in lists around the topic vectors."""
    return ListIndex.build(i.corpus(spark, sf) if rows is None else rows, i.work_dir(spark), DIM, centres=i.centroids(spark, sf))


_PROBES = """probes AS (SELECT t.query_id, t.q, p.label, row_number() OVER (PARTITION BY t.label
    ORDER BY round(1 - list_cosine_similarity(p.q, t.q), 9) + 0.0, p.label) AS o FROM topics t, topics p)"""
_PROBED_BATCH = f"""WITH {_LISTS}, {_PROBES}, pairs AS (SELECT b.query_id, c.doc_id, c.uri, c.source,
    round(1 - list_cosine_similarity(c.embedding, b.q), 9) + 0.0 AS distance
    FROM probes b JOIN placed c ON c.ivf_list = b.label WHERE o <= 3), ranked AS (SELECT *,
    row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM pairs)
    SELECT query_id, doc_id, CAST(rank AS INT) AS rank, uri, source, round(distance, 6) + 0.0 AS distance
    FROM ranked WHERE rank <= 15"""


def _batch(found):
    return found.select("query_id", "doc_id", "rank", "uri", "source", tidy("distance").alias("distance"))


@query("search_batch_indexed", _PROBED_BATCH)
def search_batch_indexed(spark, sf):
    """Every topic in its three nearest lists."""
    index = built(spark, sf)
    return _batch(s.search_batch(i.corpus(spark, sf), i.topics(spark, sf), 15, None, DIM, index=index, probes=3))


@query("search_batch_probe_join", _PROBED_BATCH)
def search_batch_probe_join(spark, sf):
    """The same with more queries than travel to a task: queries and rows meet list by list, in small blocks."""
    own = replace(DEFAULTS, broadcast_bytes=1024, block_rows=64)
    index = ListIndex.open(spark, built(spark, sf).path, own)
    return _batch(s.search_batch(i.corpus(spark, sf), i.topics(spark, sf), 15, None, DIM, own, index=index, probes=3))


@query("search_batch_all_lists", f"""WITH {BATCH} SELECT query_id, doc_id, CAST(rank AS INT) AS rank, uri, source,
    round(distance, 6) + 0.0 AS distance FROM batch WHERE rank <= 15""")
def search_batch_all_lists(spark, sf):
    """Probing every list finds what a scan finds."""
    index = built(spark, sf)
    return _batch(s.search_batch(i.corpus(spark, sf), i.topics(spark, sf), 15, None, DIM, index=index, probes=LISTS))


@query("search_exact", f"WITH {NEAR} SELECT {HIT} FROM near ORDER BY near.distance, doc_id LIMIT 25")
def search_exact(spark, sf):
    """Lists by their bound until no other can hold a nearer row."""
    return hit(built(spark, sf).search_exact(i.topic(spark, sf), 25)[0])


@query("search_coded", f"""WITH {_LISTS}, probed AS (SELECT p.label FROM topics p, topics t WHERE t.label = 3
    ORDER BY round(1 - list_cosine_similarity(p.q, t.q), 9), p.label LIMIT 3),
    near AS (SELECT c.*, round(1 - list_cosine_similarity(c.embedding, t.q), 9) + 0.0 AS distance
    FROM placed c, topics t WHERE t.label = 3 AND c.ivf_list IN (SELECT label FROM probed))
    SELECT {HIT} FROM near ORDER BY near.distance, doc_id LIMIT 20""")
def search_coded(spark, sf):
    """Ranked by codes with a pool as large as the lists, so that codes can lose nothing."""
    index = built(spark, sf)
    return hit(index.search_coded(i.topic(spark, sf), 20, 3, int(index.rows_in.sum())))


@query("search_current_index", f"""WITH {NEAR} SELECT {HIT} FROM ({POOLED}) near WHERE rn <= 100
    AND modality IN ('text', 'pdf', 'image') AND regexp_matches(text_content, '{RE}') ORDER BY near.distance, doc_id LIMIT 20""")
def search_current_index(spark, sf):
    """A filtered search after rows were appended and full lists split; all lists are read."""
    index = _kept_current(spark, sf)
    index = index.split(max(int(index.rows_in.max()) // 2, 1))
    return hit(s.search(
        i.corpus(spark, sf), i.topic(spark, sf), 20, modalities=["text", "pdf", "images"], regex=RE, index=index,
        probes=len(index.ids),
    ))


def _kept_current(spark, sf):
    rows, late = i.corpus(spark, sf), F.col("doc_id").cast("long") % 3 == 0
    return built(spark, sf, rows.where(~late)).append(rows.where(late))


@query("index_appended", f"""WITH {_LISTS}, sizes AS (SELECT ivf_list, count(*) AS n FROM placed GROUP BY ivf_list)
    SELECT 1 AS version, CAST(sum(n) AS BIGINT) AS rows, count(*) AS lists, max(n) AS largest_list FROM sizes""")
def index_appended(spark, sf):
    """What the index says of itself after a third of the rows came later."""
    return _kept_current(spark, sf).status()


# --- postings ----------------------------------------------------------------------------------------


def _postings(spark, sf):
    path = i.work_dir(spark)
    build_postings(i.documents(spark, sf), path, 8)
    return Postings(spark, path)


@query("keyword_search_indexed", f"""WITH {CORPUS}, {KEYWORD} SELECT doc_id, uri, modality, source, text_content,
    round(keyword_score, 6) AS keyword_score FROM keyword k ORDER BY k.keyword_score DESC, doc_id LIMIT 40""")
def keyword_search_indexed(spark, sf):
    """Terms of two letters and more, from postings."""
    return _postings(spark, sf).keyword_search(i.documents(spark, sf), TERMS, 40).select(
        "doc_id", "uri", "modality", "source", "text_content", F.round("keyword_score", 6).alias("keyword_score")
    )


_RARE = ("gnu general", "apache", "!! x", "q", "555-2")
_RARE_HOLD = " OR ".join(f"contains(lower(text_content), '{w}')" for w in _RARE)


@query("keyword_candidates", f"WITH {i.DOCS} SELECT doc_id FROM docs WHERE {_RARE_HOLD}")
def keyword_candidates(spark, sf):
    """Every row that holds one of some rare strings: candidates from postings, checked on the texts."""
    held, rows = _postings(spark, sf), i.documents(spark, sf)
    found = held._read(rows, held.any_of(_RARE))
    return found.where(reduce(lambda a, b: a | b, [F.contains(F.lower("text_content"), F.lit(w)) for w in _RARE])).select("doc_id")


_PATTERN = "(?i)apache lic|general pub.ic|^the rent"


@query("regex_indexed", f"WITH {i.DOCS} SELECT doc_id, length(text_content) AS chars FROM docs WHERE regexp_matches(text_content, '{_PATTERN}')")
def regex_indexed(spark, sf):
    """A pattern with plain words in each alternative."""
    return _postings(spark, sf).matching(i.documents(spark, sf), _PATTERN).select("doc_id", F.length("text_content").cast("long").alias("chars"))


# --- updates by day ----------------------------------------------------------------------------------


@query("updated_in_place", f"""WITH {i.DIRTY}, o AS (SELECT doc_id, CASE WHEN n % 90 = 8 THEN [1.0, 2.0] ELSE embedding END AS embedding,
    CASE WHEN n % 90 = 8 THEN 'new text' ELSE text_content END AS text_content, created_at FROM dirty)
    SELECT doc_id, CAST(coalesce(len(embedding), -1) AS INT) AS size, text_content, {stamp_sql()} AS created FROM o""")
def updated_in_place(spark, sf):
    """New vectors and texts of some documents, written into the days that hold them."""
    path = i.work_dir(spark)
    write_table(i.dirty(spark, sf), path)
    fresh = i.documents(spark, sf).where("doc_id % 90 = 8").select(
        "doc_id", "uri", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"), F.lit("new text").alias("text_content")
    )
    update_days(spark, path, lambda rows: c.write_embeddings(rows, fresh), fresh)
    update_days(spark, path, lambda rows: c.replace_text(rows, fresh, reset=False), fresh.select("uri"), key="uri")
    return read_table(spark, path).select(
        "doc_id", F.coalesce(F.size("embedding"), F.lit(-1)).alias("size"), "text_content", i.stamp("created_at").alias("created")
    )


@query("sql_rag_context", f"""WITH {BATCH}, r AS (SELECT *, sum(length(text_content) / 4.0) OVER (PARTITION BY query_id
    ORDER BY relevance_score DESC) AS running FROM batch WHERE rank <= 15)
    SELECT query_id, string_agg({_HEAD} || text_content || chr(10) || '---' || chr(10), chr(10)
    ORDER BY relevance_score DESC, distance, doc_id) AS context FROM r WHERE running <= 4000 GROUP BY query_id""")
def sql_rag_context(spark, sf):
    """One context per topic from a table function that reads hits in order and stops at the budget."""
    register_sql(spark, i.corpus(spark, sf))
    batch(spark, sf, 15).createOrReplaceTempView("topic_hits")
    return spark.sql("""SELECT query_id, context FROM fill_context(TABLE(SELECT query_id, uri, source, text_content,
        relevance_score, distance, doc_id FROM topic_hits) PARTITION BY query_id
        ORDER BY (relevance_score DESC, distance, doc_id), 4000)""")


@query("sql_get_rag_context", f"""WITH {CORPUS}, near AS (SELECT c.*, round(1 - list_cosine_similarity(c.embedding, o.embedding), 9)
    + 0.0 AS distance FROM corpus c, corpus o WHERE o.doc_id = '17' AND c.embedding IS NOT NULL), h AS (SELECT *,
    round(1 - distance, 3) AS relevance_score FROM ({POOLED}) WHERE rn <= 15 AND 1 - distance >= 0.7), r AS (SELECT *,
    sum(length(text_content) / 4.0) OVER (ORDER BY relevance_score DESC) AS running FROM h)
    SELECT string_agg({_HEAD} || text_content || chr(10) || '---' || chr(10), chr(10)
    ORDER BY relevance_score DESC, distance, doc_id) AS context FROM r WHERE running <= 3000 HAVING count(*) > 0""")
def sql_get_rag_context(spark, sf):
    """The same by one call, for the vector of a stored document."""
    register_sql(spark, i.corpus(spark, sf))
    stored = i.vectors(spark, sf).where("doc_id = '17'").first()["embedding"]
    return spark.sql(f"SELECT context FROM get_rag_context({sql_vector(stored)}, 3000D)")


@query("near_pairs_hashed", PAIRS + "SELECT doc1, doc2, round(1 - distance, 6) AS similarity FROM pairs WHERE distance < 0.6")
def near_pairs_hashed(spark, sf):
    """Pairs that share a bucket of sign hashes; with so small a chance to miss one the result is that of all pairs."""
    found = knn.near_pairs_hashed(i.vectors(spark, sf), 0.6, DIM, bits=5, miss=1e-6)
    return found.select("doc1", "doc2", F.round("similarity", 6).alias("similarity"))


@query("drop_known", f"WITH {i.OBJECTS}, {i.SEEN} SELECT uri, size FROM objects WHERE uri NOT IN (SELECT uri FROM seen)")
def drop_known_objects(spark, sf):
    """Objects that are not ingested yet, with a filter of their uris sent to the known side."""
    return drop_known(i.objects(spark, sf).select("uri", "size"), i.seen(spark, sf, "text", "file"))


# --- reports kept by day -----------------------------------------------------------------------------


def _daily(spark, sf, rows):
    """Reports made before and refreshed after the later half of the days was appended."""
    path, report = i.work_dir(spark), i.work_dir(spark)
    late = F.col("created_at") >= F.lit("2024-02-01").cast("timestamp")
    write_table(rows.where(~late), path)
    reports = DailyReports(spark, path, report)
    reports.refresh()
    append_days(rows.where(late), path)
    reports.refresh()
    return reports


@query("daily_modality_stats", f"""WITH {i.DOCS} SELECT modality, source, count(*) AS document_count,
    count(DISTINCT uri) AS unique_files, round(avg(length(text_content)), 6) AS avg_text_length,
    {stamp_sql('max(created_at)')} AS latest_update FROM docs GROUP BY modality, source""")
def daily_modality_stats(spark, sf):
    return _daily(spark, sf, i.documents(spark, sf)).modality_stats().withColumns(
        {"avg_text_length": F.round("avg_text_length", 6), "latest_update": i.stamp("latest_update")}
    )


@query("daily_embedding_stats", f"""WITH {i.DIRTY}, t AS (SELECT count(*) AS n, count(*) FILTER (coalesce(len(embedding), 0) > 0) AS w,
    avg(nullif(len(embedding), 0)) AS d FROM dirty WHERE text_content IS NOT NULL) SELECT n AS total_documents,
    w AS documents_with_embeddings, n - w AS documents_without_embeddings, round(d, 6) AS avg_embedding_dimension,
    round(w / n * 100, 6) AS coverage_percentage FROM t""")
def daily_embedding_stats(spark, sf):
    stats = _daily(spark, sf, i.dirty(spark, sf)).embedding_stats()
    return stats.withColumns({x: F.round(x, 6) for x in ("avg_embedding_dimension", "coverage_percentage")})


@query("listed_files", "SELECT source, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents GROUP BY source")
def listed_files(spark, sf):
    """Documents as text files, listed by the tasks, with a filter on the modality."""
    found = list_objects(spark, _write_files(spark, sf)).where("modality = 'text'")
    return found.groupBy(F.regexp_extract("uri", "source=([^/]+)", 1).alias("source")).agg(F.sum("size").alias("bytes"))
