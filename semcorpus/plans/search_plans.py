"""Search queries."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime

from pyspark.sql import functions as F

from semcorpus.api import SearchClient
from semcorpus.functions import text as t
from semcorpus.functions.text import tidy
from semcorpus.functions.vectors import cosine_distance, hash_embed
from semcorpus.operators import analytics, knn, search as s
from semcorpus.plans import inputs as i
from semcorpus.plans.inputs import CORPUS, DIM, TOPICS, near, stamp_sql
from semcorpus.plans.registry import query
from semcorpus.settings import DEFAULTS
from semcorpus.sources.schemas import DOCUMENT
from semcorpus.sources.tables import append_rows, create_tables, export_frame, read_table
from semcorpus.sources.tables import export_results as export_results_to
from semcorpus.sql_functions import create_search_view, register_sql, sql_vector

START, END = datetime(2024, 1, 3), datetime(2024, 1, 20)
NEAR = f"{CORPUS}, {TOPICS}, {near()}"
# Columns of a hit as the checks compare them.
HIT = f"doc_id, uri, modality, source, {stamp_sql()} AS created, text_content, round(distance, 6) + 0.0 AS distance"
KEPT = "WHERE rn <= {pool}"
POOLED = "SELECT *, row_number() OVER (ORDER BY distance, doc_id) AS rn FROM near"
RE = "(?i)the|der|les|que"


def hit(df):
    return df.select(
        "doc_id", "uri", "modality", "source", i.stamp("created_at").alias("created"), "text_content",
        tidy("distance").alias("distance"),
    )


@query("knn", f"WITH {NEAR} SELECT {HIT} FROM near ORDER BY near.distance, doc_id LIMIT 25")
def knn_topic(spark, sf):
    return hit(knn.knn(i.corpus(spark, sf), i.topic(spark, sf), 25))


@query("cosine_to_topic", f"""WITH {TOPICS} SELECT CAST(e.vec_id AS VARCHAR) AS doc_id, t.query_id,
    round(round(1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), t.q), 9), 6) + 0.0 AS distance
    FROM embeddings e JOIN topics t ON t.label = e.label""")
def cosine_to_topic(spark, sf):
    both = i.vectors(spark, sf).join(i.topics(spark, sf), "label")
    return both.select("doc_id", "query_id", tidy(cosine_distance("embedding", "q")).alias("distance"))


@query("search_filtered", f"""WITH {NEAR} SELECT {HIT} FROM ({POOLED}) near WHERE rn <= 100
    AND modality IN ('text', 'pdf', 'image') AND regexp_matches(text_content, '{RE}')
    AND created_at BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' ORDER BY near.distance, doc_id LIMIT 20""")
def search_filtered(spark, sf):
    return hit(s.search(
        i.corpus(spark, sf), i.topic(spark, sf), 20, modalities=["text", "pdf", "images"], regex=RE,
        start=START, end=END,
    ))


@query("search_prefiltered", f"""WITH {NEAR} SELECT {HIT} FROM near WHERE modality IN ('text', 'pdf', 'image')
    AND regexp_matches(text_content, '{RE}') AND source IN ('src1', 'src2', 'src3', 'src4', 'src5')
    ORDER BY near.distance, doc_id LIMIT 20""")
def search_prefiltered(spark, sf):
    return hit(s.search(
        i.corpus(spark, sf), i.topic(spark, sf), 20, modalities=["text", "pdf", "images"], regex=RE,
        sources=["src1", "src2", "src3", "src4", "src5"], prefilter=True,
    ))


def _semantic(pool, extra="TRUE"):
    return f"""WITH {NEAR} SELECT doc_id, uri, source, modality, text_content,
    round(1 - distance, 3) + 0.0 AS relevance_score, {stamp_sql()} AS created, meta AS metadata
    FROM ({POOLED}) WHERE rn <= {pool} AND {extra}"""


def _semantic_columns(df):
    return df.select(
        "doc_id", "uri", "source", "modality", "text_content", tidy("relevance_score", 3).alias("relevance_score"),
        i.stamp("created_at").alias("created"), "metadata",
    )


@query("semantic_search", _semantic(30, "1 - distance >= 0.3"))
def semantic_search(spark, sf):
    return _semantic_columns(s.semantic_search(i.corpus(spark, sf), i.topic(spark, sf), 30, 0.3))


@query("quick_search", _semantic(10))
def quick_search(spark, sf):
    return _semantic_columns(s.quick_search(i.corpus(spark, sf), i.topic(spark, sf)))


SOURCES = ["src2", "src5", "src7", "src11", "src13"]


@query("search_by_source", _semantic(50, "source IN ('src2', 'src5', 'src7', 'src11', 'src13')"))
def search_by_source(spark, sf):
    return _semantic_columns(s.search_by_source(i.corpus(spark, sf), i.topic(spark, sf), SOURCES, 50))


@query("search_by_date", _semantic(50, "CAST(created_at AS DATE) BETWEEN DATE '2024-01-04' AND DATE '2024-01-12'"))
def search_by_date(spark, sf):
    return _semantic_columns(
        s.search_by_date(i.corpus(spark, sf), i.topic(spark, sf), date(2024, 1, 4), date(2024, 1, 12), 50)
    )


@query("search_content", f"WITH {NEAR} SELECT text_content FROM ({POOLED}) WHERE rn <= 5")
def search_content(spark, sf):
    return s.search_content(i.corpus(spark, sf), i.topic(spark, sf), 5)


@query("semantic_grep_table", f"""WITH {NEAR} SELECT {HIT}, CAST(NULL AS DOUBLE) AS rel_score FROM ({POOLED}) near
    WHERE rn <= 75 AND source IN ('src2', 'src5', 'src7', 'src11', 'src13')
    AND created_at BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' AND regexp_matches(text_content, '{RE}')
    ORDER BY near.distance, doc_id LIMIT 15""")
def semantic_grep_table(spark, sf):
    found = s.semantic_grep_table(i.corpus(spark, sf), i.topic(spark, sf), 15, SOURCES, START, END, RE)
    return hit(found).withColumn("rel_score", F.lit(None).cast("double"))


@query("semantic_grep", f"""WITH {NEAR} SELECT {HIT}, 0.5::DOUBLE AS rel_score FROM ({POOLED}) near WHERE rn <= 50
    ORDER BY near.distance, doc_id LIMIT 8""")
def semantic_grep(spark, sf):
    found = s.semantic_grep(i.corpus(spark, sf), i.topic(spark, sf), 8)
    return hit(found).withColumn("rel_score", F.lit(0.5))


@query("search_similar", f"""WITH {CORPUS}, near AS (SELECT c.*,
    round(1 - list_cosine_similarity(c.embedding, o.embedding), 9) + 0.0 AS distance FROM corpus c, corpus o
    WHERE o.doc_id = '17' AND c.embedding IS NOT NULL AND o.embedding IS NOT NULL)
    SELECT {HIT} FROM ({POOLED}) near WHERE rn <= 13 AND doc_id <> '17' ORDER BY near.distance, doc_id LIMIT 12""")
def search_similar(spark, sf):
    return hit(s.search_similar(i.corpus(spark, sf), "17", 12))


TERMS = "the of und les que"
_HITS = " + ".join(f"CAST(contains(lower(text_content), '{w}') AS INT)" for w in TERMS.split())
KEYWORD = f"keyword AS (SELECT *, ({_HITS}) / 5.0::DOUBLE AS keyword_score FROM corpus WHERE ({_HITS}) > 0)"


@query("keyword_scores", f"WITH {CORPUS}, {KEYWORD} SELECT doc_id, round(keyword_score, 6) AS keyword_score FROM keyword")
def keyword_scores(spark, sf):
    """The predicate and score over all rows."""
    terms = t.query_terms(TERMS)
    rows = i.documents(spark, sf).where(t.keyword_match("text_content", terms))
    return rows.select("doc_id", F.round(t.keyword_score("text_content", terms), 6).alias("keyword_score"))


@query("keyword_search", f"""WITH {CORPUS}, {KEYWORD} SELECT doc_id, uri, modality, source, text_content,
    round(keyword_score, 6) AS keyword_score FROM keyword k ORDER BY k.keyword_score DESC, doc_id LIMIT 40""")
def keyword_search(spark, sf):
    return s.keyword_search(i.documents(spark, sf), TERMS, 40).select(
        "doc_id", "uri", "modality", "source", "text_content", F.round("keyword_score", 6).alias("keyword_score")
    )


@query("hybrid_search", f"""WITH {NEAR}, {KEYWORD}, v AS (SELECT * FROM ({POOLED}) WHERE rn <= 200 AND rn <= 40),
    w AS (SELECT * FROM keyword ORDER BY keyword_score DESC, doc_id LIMIT 40)
    SELECT coalesce(v.doc_id, w.doc_id) AS doc_id, coalesce(v.uri, w.uri) AS uri,
    coalesce(v.text_content, w.text_content) AS text_content,
    round(coalesce(0.7 / (1 + v.distance), 0) + coalesce(0.3 * w.keyword_score, 0), 6) AS combined_score
    FROM v FULL OUTER JOIN w ON v.doc_id = w.doc_id
    ORDER BY round(coalesce(0.7 / (1 + v.distance), 0) + coalesce(0.3 * w.keyword_score, 0), 9) DESC,
    coalesce(v.doc_id, w.doc_id) LIMIT 20""")
def hybrid_search(spark, sf):
    found = s.hybrid_search(i.corpus(spark, sf), i.topic(spark, sf), TERMS, 20)
    return found.select("doc_id", "uri", "text_content", F.round("combined_score", 6).alias("combined_score"))


ASK = "the order of the heart and the rest"


def _rerank(k: int) -> str:
    return f"""WITH {NEAR}, pool AS (SELECT * FROM ({POOLED}) WHERE rn <= {3 * k}),
    ask AS (SELECT list_distinct(list_filter(regexp_split_to_array(lower('{ASK}'), '[^\\p{{L}}\\p{{N}}]+'),
        lambda x: x <> '')) AS words),
    scored AS (SELECT doc_id, uri, modality, source, text_content, distance,
    10.0 * len(list_intersect(ask.words, list_filter(regexp_split_to_array(lower(substr(text_content, 1, 1000)),
        '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))) / len(ask.words) AS score FROM pool, ask)
    SELECT doc_id, uri, modality, source, text_content, round(distance, 6) + 0.0 AS distance,
    round(score, 6) AS relevance_score FROM scored z ORDER BY score DESC, z.distance, doc_id LIMIT {k}"""


def _reranked(spark, sf, k):
    found = s.rerank(i.corpus(spark, sf), i.topic(spark, sf), k, query_text=ASK)
    return found.select(
        "doc_id", "uri", "modality", "source", "text_content", tidy("distance").alias("distance"),
        F.round("relevance_score", 6).alias("relevance_score"),
    )


@query("rerank", _rerank(12))
def rerank(spark, sf):
    return _reranked(spark, sf, 12)


@query("rerank_20", _rerank(20))
def rerank_20(spark, sf):
    return _reranked(spark, sf, 20)


@query("rerank_50", _rerank(50))
def rerank_50(spark, sf):
    """All of the 150 candidates are scored."""
    return _reranked(spark, sf, 50)


@query("relevant_docs", f"""WITH {NEAR} SELECT doc_id AS id, uri AS path, substr(text_content, 1, 200) AS snippet
    FROM ({POOLED}) WHERE rn <= 20 AND 1 - distance > 0.33""")
def relevant_docs(spark, sf):
    return s.relevant_docs(i.corpus(spark, sf), i.topic(spark, sf), 0.33, 20)


@query("search_view", f"""WITH {NEAR} SELECT doc_id, uri, source, modality, {stamp_sql()} AS created, text_content,
    round(distance, 6) + 0.0 AS similarity_score FROM ({POOLED}) WHERE rn <= 20""")
def search_view(spark, sf):
    create_search_view(i.corpus(spark, sf), i.topic(spark, sf), 20, "search_interface")
    return spark.table("search_interface").select(
        "doc_id", "uri", "source", "modality", i.stamp("created_at").alias("created"), "text_content",
        tidy("similarity_score").alias("similarity_score"),
    )


@query("client_search", f"""WITH {NEAR} SELECT doc_id, uri, source, modality, round(distance, 6) + 0.0 AS score,
    round(1 - distance, 3) AS relevance_score, text_content AS content, {stamp_sql()} AS created
    FROM ({POOLED}) z WHERE rn <= 60 AND source IN ('src2', 'src5', 'src7', 'src11', 'src13')
    ORDER BY z.distance, doc_id LIMIT 12""")
def client_search(spark, sf):
    found = SearchClient(spark, i.corpus(spark, sf)).search(i.topic(spark, sf), 12, sources=SOURCES)
    return found.select(
        "doc_id", "uri", "source", "modality", tidy("score").alias("score"), "relevance_score", "content",
        i.stamp("metadata.created_at").alias("created"),
    )


@query("client_stats", f"""WITH {i.DOCS} SELECT count(*) AS document_count, {stamp_sql('max(created_at)')} AS latest,
    'corpus' AS dataset_name, false AS index_exists FROM docs""")
def client_stats(spark, sf):
    stats = SearchClient(spark, i.corpus(spark, sf), i.documents(spark, sf)).stats()
    return stats.withColumn("latest", i.stamp("latest"))


@query("export_results", f"""WITH {NEAR} SELECT CAST(rn AS INT) AS rank, doc_id, uri, source, modality,
    round(distance, 6) + 0.0 AS score, substr(text_content, 1, 500) AS text_content
    FROM ({POOLED}) WHERE rn <= 15""")
def export_results(spark, sf):
    found = s.search(i.corpus(spark, sf), i.topic(spark, sf), 15)
    return export_frame(found).withColumn("score", tidy("score"))


@query("exported_csv", f"""WITH {NEAR} SELECT CAST(rn AS VARCHAR) AS rank, doc_id, uri, source, modality,
    substr(text_content, 1, 500) AS text_content FROM ({POOLED}) WHERE rn <= 15""")
def exported_csv(spark, sf):
    """The export written as CSV and read back as text."""
    path = i.work_dir(spark) + "/csv"
    export_results_to(s.search(i.corpus(spark, sf), i.topic(spark, sf), 15), path)
    return spark.read.csv(path, header=True, multiLine=True, escape='"').drop("score")


@query("exported_json", f"""WITH {NEAR} SELECT doc_id, uri, source, text_content, round(distance, 6) + 0.0 AS distance
    FROM ({POOLED}) WHERE rn <= 15""")
def exported_json(spark, sf):
    """The hits written as JSON lines, with their distance, and read back."""
    path = i.work_dir(spark) + "/json"
    export_results_to(s.search(i.corpus(spark, sf), i.topic(spark, sf), 15), path, "json")
    kind = "doc_id string, uri string, source string, text_content string, distance double"
    return spark.read.schema(kind).json(path).withColumn("distance", tidy("distance"))


@query("appended_rows", f"""WITH {NEAR} SELECT doc_id, uri, source, modality, {stamp_sql()} AS created
    FROM ({POOLED}) WHERE rn <= 15""")
def appended_rows(spark, sf):
    """Hits that a caller holds in memory, appended to a created table in two parts and read back without a schema."""
    root = i.work_dir(spark)
    create_tables(spark, root)
    held = [r.asDict() for r in s.search(i.corpus(spark, sf), i.topic(spark, sf), 15).collect()]
    for part in (held[:7], held[7:]):
        append_rows(spark, part, DOCUMENT, f"{root}/documents", ("modality", "source"))
    return read_table(spark, f"{root}/documents").select("doc_id", "uri", "source", "modality", i.stamp("created_at").alias("created"))


# Every topic against the whole corpus.
BATCH = f"""{CORPUS}, {TOPICS}, pairs AS (SELECT t.query_id, c.*,
    round(1 - list_cosine_similarity(c.embedding, t.q), 9) + 0.0 AS distance FROM corpus c, topics t
    WHERE c.embedding IS NOT NULL), batch AS (SELECT *, round(1 - distance, 3) AS relevance_score,
    row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM pairs)"""


def batch(spark, sf, k, threshold=None):
    return s.search_batch(i.corpus(spark, sf), i.topics(spark, sf), k, threshold, DIM)


@query("search_batch", f"""WITH {BATCH} SELECT query_id, doc_id, CAST(rank AS INT) AS rank, uri, source, text_content,
    round(distance, 6) + 0.0 AS distance FROM batch WHERE rank <= 15""")
def search_batch(spark, sf):
    return batch(spark, sf, 15).select(
        "query_id", "doc_id", "rank", "uri", "source", "text_content", tidy("distance").alias("distance")
    )


@query("text_search_batch", f"""WITH {i.hashed('documents', 'doc_id', 'text', 'dv')},
    {i.hashed('benchmark', 'item_id', 'text', 'qv')}, pairs AS (SELECT CAST(q.k AS VARCHAR) AS query_id,
    CAST(d.k AS VARCHAR) AS doc_id, round(1 - list_cosine_similarity(d.vec, q.vec), 9) + 0.0 AS distance
    FROM dv d, qv q) SELECT query_id, doc_id, CAST(rank AS INT) AS rank, round(distance, 6) + 0.0 AS distance FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM pairs)
    WHERE rank <= 5""")
def text_search_batch(spark, sf):
    """Every benchmark text, whole, against every document, whole."""
    docs = i.documents(spark, sf).select("doc_id", hash_embed("text_content", DIM).alias("embedding"))
    asked = s.text_queries(i.table(spark, sf, "benchmark"), "item_id", "text", DIM)
    return knn.knn_join(asked, docs, 5, DIM).withColumn("distance", tidy("distance"))


@query("projected_fields", f"""WITH {i.DOCS} SELECT doc_id, regexp_extract(uri, '([^/]+)$', 1) AS file_name,
    upper(regexp_extract(uri, '\\.([^.]+)$', 1)) AS format,
    CASE WHEN length(text_content) > 200 THEN substr(text_content, 1, 200) || '...' ELSE text_content END AS preview,
    round(length(text_content) / 4.0, 6) AS tokens, CAST(length(text_content) // 4 AS BIGINT) AS whole_tokens,
    CASE source WHEN 'pdf' THEN '📄' WHEN 'video' THEN '🎥' ELSE '📝' END AS icon FROM docs""")
def projected_fields(spark, sf):
    return i.documents(spark, sf).select(
        "doc_id", t.file_name("uri").alias("file_name"), t.file_format("uri").alias("format"),
        t.preview("text_content", 200).alias("preview"), F.round(t.token_estimate("text_content"), 6).alias("tokens"),
        t.token_estimate("text_content", whole=True).alias("whole_tokens"), analytics.media_icon().alias("icon"),
    )


@query("row_sample", f"""WITH {i.DOCS} SELECT doc_id, uri FROM docs
    WHERE ('0x' || substr(md5(doc_id), 1, 8))::BIGINT % 100 < 25""")
def row_sample(spark, sf):
    """A quarter of the rows, chosen by a hash of the id: the same rows everywhere and every time."""
    return t.row_sample(i.documents(spark, sf), 25).select("doc_id", "uri")


# --- SQL functions -----------------------------------------------------------------------------------


def _sql(spark, sf, text):
    register_sql(spark, i.corpus(spark, sf))
    return spark.sql(text.format(q=sql_vector(i.topic(spark, sf))))


@query("sql_semantic_search", _semantic(30, "1 - distance >= 0.3"))
def sql_semantic_search(spark, sf):
    return _semantic_columns(_sql(spark, sf, "SELECT * FROM semantic_search({q}, 30, 0.3D)"))


@query("sql_search", _semantic(10))
def sql_search(spark, sf):
    return _semantic_columns(_sql(spark, sf, "SELECT * FROM search({q})"))


@query("sql_search_by_source", _semantic(50, "source IN ('src2', 'src5', 'src7', 'src11', 'src13')"))
def sql_search_by_source(spark, sf):
    names = "array('src2', 'src5', 'src7', 'src11', 'src13')"
    return _semantic_columns(_sql(spark, sf, f"SELECT * FROM search_by_source({{q}}, {names}, 50)"))


@query("sql_search_by_date", _semantic(50, "CAST(created_at AS DATE) BETWEEN DATE '2024-01-04' AND DATE '2024-01-12'"))
def sql_search_by_date(spark, sf):
    return _semantic_columns(
        _sql(spark, sf, "SELECT * FROM search_by_date({q}, DATE '2024-01-04', DATE '2024-01-12', 50)")
    )


@query("sql_search_content", f"WITH {NEAR} SELECT text_content FROM ({POOLED}) WHERE rn <= 5")
def sql_search_content(spark, sf):
    return _sql(spark, sf, "SELECT * FROM search_content({q}, 5)")


@query("sql_semantic_grep", f"""WITH {NEAR} SELECT {HIT} FROM ({POOLED}) near
    WHERE rn <= 75 AND source IN ('src2', 'src5', 'src7', 'src11', 'src13')
    AND created_at BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' AND regexp_matches(text_content, '{RE}')
    ORDER BY near.distance, doc_id LIMIT 15""")
def sql_semantic_grep(spark, sf):
    names = "array('src2', 'src5', 'src7', 'src11', 'src13')"
    return hit(_sql(
        spark, sf,
        f"SELECT * FROM semantic_grep_tf({{q}}, 15, {names}, TIMESTAMP '{START}', TIMESTAMP '{END}', '{RE}')",
    ))


ASKED = "the order of the heart and the rest"
_ASKED = f"""WITH {i.DOCS}, {i.hashed('documents', 'doc_id', 'text', 'dv')}, asked AS (SELECT 0 AS k, '{ASKED}' AS text),
    {i.hashed('asked', 'k', 'text', 'qv')}, near AS (SELECT d.*, round(1 - list_cosine_similarity(v.vec, q.vec), 9) + 0.0
    AS distance FROM docs d JOIN dv v ON v.k = d.n, qv q)"""


@query("sql_text_search", f"""{_ASKED} SELECT doc_id, source, round(1 - distance, 3) + 0.0 AS relevance_score, text_content
    FROM ({POOLED}) WHERE rn <= 25 AND 1 - distance >= 0.01""")
def sql_text_search(spark, sf):
    """A search by words, all in SQL, over documents that are embedded by their words."""
    rows = i.documents(spark, sf).withColumn("embedding", hash_embed("text_content", DIM))
    register_sql(spark, rows, settings=replace(DEFAULTS, dim=DIM))
    return spark.sql(f"SELECT * FROM semantic_search_text('{ASKED}', 25, 0.01D)").select(
        "doc_id", "source", tidy("relevance_score", 3).alias("relevance_score"), "text_content"
    )


@query("sql_lateral_batch", f"""WITH {BATCH} SELECT query_id, doc_id, source, round(distance, 6) + 0.0 AS distance
    FROM batch WHERE rank <= 8""")
def sql_lateral_batch(spark, sf):
    """The search function once per row of a table of queries."""
    register_sql(spark, i.corpus(spark, sf))
    i.topics(spark, sf).createOrReplaceTempView("asked_topics")
    found = spark.sql("SELECT a.query_id, h.* FROM asked_topics a, LATERAL semantic_search(a.q, 8, -2D) h")
    return found.select("query_id", "doc_id", "source", tidy("distance").alias("distance"))


# --- index and pairs ---------------------------------------------------------------------------------

_UNIT = "vecs AS (SELECT CAST(vec_id AS VARCHAR) AS doc_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"
_LISTS = f"""{CORPUS}, {TOPICS}, placed AS (SELECT c.*, (SELECT arg_min(t.label,
    (round(1 - list_cosine_similarity(c.embedding, t.q), 9) + 0.0, t.label)) FROM topics t) AS ivf_list
    FROM corpus c WHERE c.embedding IS NOT NULL)"""


def _indexed(spark, sf):
    path = i.work_dir(spark)
    knn.ivf_build(i.corpus(spark, sf), i.centroids(spark, sf), path)
    return path


@query("ivf_lists", f"WITH {_LISTS} SELECT CAST(ivf_list AS INT) AS ivf_list, count(*) AS rows FROM placed GROUP BY ivf_list")
def ivf_lists(spark, sf):
    return knn.list_sizes(spark.read.parquet(f"{_indexed(spark, sf)}/rows"))


@query("ivf_search", f"""WITH {_LISTS}, probed AS (SELECT p.label FROM topics p, topics t WHERE t.label = 3
    ORDER BY round(1 - list_cosine_similarity(p.q, t.q), 9), p.label LIMIT 3),
    near AS (SELECT c.*, round(1 - list_cosine_similarity(c.embedding, t.q), 9) + 0.0 AS distance
    FROM placed c, topics t WHERE t.label = 3 AND c.ivf_list IN (SELECT label FROM probed))
    SELECT {HIT} FROM near ORDER BY near.distance, doc_id LIMIT 20""")
def ivf_search(spark, sf):
    path = _indexed(spark, sf)
    cents = knn.load_centroids(spark, path)
    return hit(knn.ivf_search(spark.read.parquet(f"{path}/rows"), cents, i.topic(spark, sf), 20, 3))


PROBED = f"""{_LISTS}, probed AS (SELECT p.label FROM topics p, topics t WHERE t.label = 3
    ORDER BY round(1 - list_cosine_similarity(p.q, t.q), 9), p.label LIMIT 4),
    near AS (SELECT c.*, round(1 - list_cosine_similarity(c.embedding, t.q), 9) + 0.0 AS distance
    FROM placed c, topics t WHERE t.label = 3 AND c.ivf_list IN (SELECT label FROM probed))"""


@query("search_indexed", f"""WITH {PROBED} SELECT {HIT} FROM ({POOLED}) near WHERE rn <= 100
    AND modality IN ('text', 'pdf', 'image') AND regexp_matches(text_content, '{RE}') ORDER BY near.distance, doc_id LIMIT 20""")
def search_indexed(spark, sf):
    """A filtered search that reads four of the index's lists."""
    rows = i.corpus(spark, sf)
    return hit(s.search(
        rows, i.topic(spark, sf), 20, modalities=["text", "pdf", "images"], regex=RE, index=_indexed(spark, sf), probes=4,
    ))


@query("semantic_search_indexed", f"""WITH {PROBED} SELECT doc_id, uri, source, modality, text_content,
    round(1 - distance, 3) + 0.0 AS relevance_score, {stamp_sql()} AS created, meta AS metadata
    FROM ({POOLED}) WHERE rn <= 30 AND 1 - distance >= 0.3""")
def semantic_search_indexed(spark, sf):
    found = s.semantic_search(i.corpus(spark, sf), i.topic(spark, sf), 30, 0.3, index=_indexed(spark, sf), probes=4)
    return _semantic_columns(found)


@query("client_search_indexed", f"""WITH {PROBED} SELECT doc_id, uri, source, modality, round(distance, 6) + 0.0 AS score,
    round(1 - distance, 3) AS relevance_score, text_content AS content
    FROM ({POOLED}) z WHERE rn <= 60 AND source IN ('src2', 'src5', 'src7', 'src11', 'src13')
    AND modality IN ('text', 'image') ORDER BY z.distance, doc_id LIMIT 12""")
def client_search_indexed(spark, sf):
    client = SearchClient(spark, i.corpus(spark, sf), index_path=_indexed(spark, sf), probes=4)
    found = client.search(i.topic(spark, sf), 12, sources=SOURCES, modalities=["text", "images"])
    return found.select("doc_id", "uri", "source", "modality", tidy("score").alias("score"), "relevance_score", "content")


@query("trained_index", f"WITH {NEAR} SELECT {HIT} FROM near ORDER BY near.distance, doc_id LIMIT 20")
def trained_index(spark, sf):
    """Eight lists trained on all vectors; reading all of them finds what a scan finds."""
    rows = i.corpus(spark, sf)
    path = i.work_dir(spark)
    cents = knn.train_centroids(rows, 8, DIM)
    knn.ivf_build(rows, cents, path)
    return hit(s.search(rows, i.topic(spark, sf), 20, candidates=20, index=path, probes=len(cents)))


@query("index_status", f"""WITH {_LISTS}, sizes AS (SELECT ivf_list, count(*) AS n FROM placed GROUP BY ivf_list)
    SELECT true AS "exists", CAST(sum(n) AS BIGINT) AS rows, count(*) AS lists, max(n) AS largest_list FROM sizes""")
def index_status(spark, sf):
    return knn.index_status(spark, _indexed(spark, sf)).drop("last_updated")


PAIRS = f"""WITH {_UNIT}, pairs AS (SELECT a.doc_id AS doc1, b.doc_id AS doc2,
    round(1 - list_cosine_similarity(a.embedding, b.embedding), 9) + 0.0 AS distance
    FROM vecs a JOIN vecs b ON a.doc_id < b.doc_id) """
_PAIR_OUT = "SELECT doc1, doc2, round(1 - distance, 6) AS similarity FROM pairs WHERE distance < 0.65"


@query("near_pairs", PAIRS + _PAIR_OUT)
def near_pairs(spark, sf):
    found = knn.near_pairs(i.vectors(spark, sf), 0.65, DIM)
    return found.select("doc1", "doc2", F.round("similarity", 6).alias("similarity"))


@query("near_pairs_by_cell", PAIRS + _PAIR_OUT)
def near_pairs_by_cell(spark, sf):
    """The same pairs through cells around the topic vectors."""
    found = knn.near_pairs(i.vectors(spark, sf), 0.65, DIM, i.centroids(spark, sf))
    return found.select("doc1", "doc2", F.round("similarity", 6).alias("similarity"))


@query("near_pairs_trained", PAIRS + _PAIR_OUT)
def near_pairs_trained(spark, sf):
    """The same pairs through cells trained on all vectors, in small blocks."""
    own = replace(DEFAULTS, pair_rows=100, block_rows=128)
    found = knn.near_pairs(i.vectors(spark, sf), 0.65, DIM, settings=own)
    return found.select("doc1", "doc2", F.round("similarity", 6).alias("similarity"))


@query("search_batch_blocks", f"""WITH {BATCH} SELECT query_id, doc_id, CAST(rank AS INT) AS rank,
    round(distance, 6) + 0.0 AS distance FROM batch WHERE rank <= 15""")
def search_batch_blocks(spark, sf):
    """More queries than travel to a task: queries and rows meet block by block."""
    own = replace(DEFAULTS, broadcast_bytes=1024, block_rows=64)
    found = knn.knn_join(i.topics(spark, sf), i.corpus(spark, sf), 15, DIM, settings=own)
    return found.select("query_id", "doc_id", "rank", tidy("distance").alias("distance"))


@query("similar_docs", PAIRS + """SELECT doc1, string_agg(doc2 || '=' || printf('%.4f', 1 - distance), ','
    ORDER BY distance, doc2) AS similar_docs FROM (SELECT *, row_number() OVER (PARTITION BY doc1
    ORDER BY distance, doc2) AS rn FROM pairs WHERE distance < 0.75) WHERE rn <= 5 GROUP BY doc1""")
def similar_docs(spark, sf):
    found = knn.similar_docs(i.vectors(spark, sf), 0.75, 5, DIM)
    shown = F.transform("similar_docs", lambda x: F.format_string("%s=%.4f", x["doc2"], x["similarity"]))
    return found.select("doc1", F.array_join(shown, ",").alias("similar_docs"))


@query("distinct_vectors", """WITH v AS (SELECT CAST(embedding AS DOUBLE[]) AS e, min(CAST(vec_id AS VARCHAR)) AS doc_id,
    count(*) AS copies FROM embeddings GROUP BY 1) SELECT doc_id, copies FROM v""")
def distinct_vectors(spark, sf):
    return knn.distinct_vectors(i.vectors(spark, sf)).select("doc_id", "copies")
