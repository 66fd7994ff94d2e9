"""Chunk, corpus and embedding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from semcorpus.functions.text import tidy
from semcorpus.functions.vectors import hash_embed, unit
from semcorpus.operators import chunk as k, corpus as c, knn, quality as q
from semcorpus.plans import inputs as i
from semcorpus.plans.inputs import CORPUS, DIM, DIRTY, DOCS, stamp_sql
from semcorpus.plans.registry import query
from semcorpus.settings import Settings
from semcorpus.streaming.incremental import feed_corpus

CHUNKS = f"""{DOCS}, spread AS (SELECT *, unnest(range(CAST(ceil(length(text_content) / 800.0) AS BIGINT))) AS j
    FROM docs WHERE length(text_content) > 2000),
    chunks AS (SELECT doc_id || ':' || j AS doc_id, uri, modality, source, created_at, j AS chunk_index,
    j * 800 AS chunk_start, least(j * 800 + 1200, length(text_content)) AS chunk_end,
    substr(text_content, CAST(j * 800 + 1 AS BIGINT), 1200) AS text_content FROM spread),
    assembled AS (SELECT doc_id, uri, chunk_index, text_content, modality, source, created_at FROM chunks UNION ALL
    SELECT doc_id, uri, NULL, text_content, modality, source, created_at FROM docs WHERE length(text_content) <= 2000)"""


def _chunks(spark, sf):
    return k.chunk_fixed(i.documents(spark, sf))


@query("chunk_fixed", f"""WITH {CHUNKS} SELECT doc_id, uri, modality, source, {stamp_sql()} AS created, chunk_index,
    chunk_start, chunk_end, text_content FROM chunks""")
def chunk_fixed(spark, sf):
    return _chunks(spark, sf).select(
        "doc_id", "uri", "modality", "source", i.stamp("created_at").alias("created"), "chunk_index", "chunk_start",
        "chunk_end", "text_content",
    )


# The packing as a recursion over the sentences of every text at once: one state row per text and step.
_REPEAT = """len(list_filter(range(1, len(f.held) + 1),
    lambda r: list_sum(list_transform(f.held[-r:], lambda x: length(x))) <= 200))"""
PACKED = f"""{DOCS}, split AS (SELECT doc_id, string_split(replace(replace(replace(text_content, '! ', '!' || chr(1)),
        '? ', '?' || chr(1)), '. ', '.' || chr(1)), chr(1)) AS sents FROM docs WHERE length(text_content) > 2000),
    fold AS (SELECT doc_id, 0::BIGINT AS step, []::VARCHAR[] AS held, 0::BIGINT AS held_len, 0::BIGINT AS start,
        0::BIGINT AS number, NULL::VARCHAR AS body, 0::BIGINT AS begins, 0::BIGINT AS no, false AS wide FROM split
    UNION ALL SELECT g.doc_id, g.step + 1,
        CASE WHEN fits THEN list_append(held, x) WHEN len(held) > 0 THEN list_append(held[len(held) - rep + 1:], x)
            ELSE [] END,
        CASE WHEN fits THEN held_len + length(x) WHEN len(held) > 0 THEN rep_len + length(x) ELSE 0 END,
        CASE WHEN fits THEN start WHEN len(held) > 0 THEN start + length(array_to_string(held, ' ')) - rep_len
            ELSE start + length(x) END,
        CASE WHEN fits OR (len(held) = 0 AND length(x) > 2000) THEN number ELSE number + 1 END,
        CASE WHEN fits THEN NULL WHEN len(held) > 0 THEN array_to_string(held, ' ') ELSE x END,
        start, number, NOT fits AND len(held) = 0 AND length(x) > 2000
    FROM (SELECT h.*, coalesce(list_sum(list_transform(h.held[len(h.held) - h.rep + 1:], lambda y: length(y))), 0)::BIGINT
        AS rep_len FROM (SELECT f.*, s.sents[f.step + 1] AS x, f.held_len + length(s.sents[f.step + 1]) <= 1000 AS fits,
        {_REPEAT} AS rep FROM fold f JOIN split s ON s.doc_id = f.doc_id WHERE f.step < len(s.sents)) h) g),
    bodies AS (SELECT doc_id, body, begins, no, wide FROM fold WHERE body IS NOT NULL UNION ALL
        SELECT f.doc_id, array_to_string(f.held, ' '), f.start, f.number, false FROM fold f
        JOIN split s ON s.doc_id = f.doc_id WHERE f.step = len(s.sents) AND len(f.held) > 0),
    windows AS (SELECT *, unnest(range(CAST(ceil(length(body) / 800.0) AS BIGINT))) AS j FROM bodies WHERE wide)"""


@query("chunk_sentences", f"""WITH RECURSIVE {PACKED} SELECT doc_id || ':' || no AS doc_id, no AS chunk_index, begins AS chunk_start,
    begins + length(body) AS chunk_end, body AS text_content FROM bodies WHERE NOT wide UNION ALL
    SELECT doc_id || '_sent' || no || ':' || j, j, j * 800, least(j * 800 + 1200, length(body)),
    substr(body, CAST(j * 800 + 1 AS BIGINT), 1200) FROM windows""")
def chunk_sentences(spark, sf):
    """An ordered fold per text."""
    return k.chunk_sentences(i.documents(spark, sf)).select(
        "doc_id", "chunk_index", "chunk_start", "chunk_end", "text_content"
    )


@query("chunk_words", """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws
    FROM documents), s AS (SELECT *, unnest(range(CAST(ceil(len(ws) / 400.0) AS BIGINT))) AS j FROM w WHERE len(ws) > 0)
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(j AS INT) AS chunk_index,
    array_to_string(ws[j * 400 + 1 : j * 400 + 500], ' ') AS text FROM s""")
def chunk_words(spark, sf):
    texts = i.documents(spark, sf).select("doc_id", F.col("text_content").alias("text"))
    return k.chunk_words(texts).select("doc_id", "chunk_index", "text")


@query("search_corpus", f"WITH {CHUNKS} SELECT doc_id, uri, chunk_index, text_content FROM assembled")
def search_corpus(spark, sf):
    found = c.search_corpus(i.documents(spark, sf), _chunks(spark, sf))
    return found.select("doc_id", "uri", "chunk_index", "text_content")


@query("build_corpus", f"WITH {CHUNKS} SELECT doc_id, uri, chunk_index, text_content FROM assembled")
def build_corpus(spark, sf):
    """The same corpus in one pass."""
    return c.build_corpus(i.documents(spark, sf)).select("doc_id", "uri", "chunk_index", "text_content")


@query("not_chunked", f"""WITH {CHUNKS} SELECT doc_id, uri FROM docs WHERE doc_id NOT IN (
    SELECT split_part(doc_id, ':', 1) FROM chunks)""")
def not_chunked(spark, sf):
    return c.not_chunked(i.documents(spark, sf), _chunks(spark, sf)).select("doc_id", "uri")


@query("chunk_stats", f"""WITH {CHUNKS}, t AS (SELECT count(DISTINCT split_part(doc_id, ':', 1)) AS original_documents,
    count(*) AS total_chunks, avg(length(text_content)) AS a, CAST(min(length(text_content)) AS INT) AS min_chunk_size,
    CAST(max(length(text_content)) AS INT) AS max_chunk_size, avg(chunk_index) AS b FROM chunks)
    SELECT original_documents, total_chunks, round(a, 6) AS avg_chunk_size, min_chunk_size, max_chunk_size,
    round(b, 6) AS avg_chunk_index, round(total_chunks / original_documents, 6) AS avg_chunks_per_doc FROM t""")
def chunk_stats(spark, sf):
    stats = q.chunk_stats(_chunks(spark, sf))
    return stats.withColumns({x: F.round(x, 6) for x in ("avg_chunk_size", "avg_chunk_index", "avg_chunks_per_doc")})


def _weights(df, key, vec, dim):
    """Non-zero elements of a vector, one per row."""
    flat = df.select(key, F.posexplode(vec).alias("bucket", "weight"))
    return flat.where(F.col("weight") != 0).withColumn("weight", F.round("weight", 6))


@query("embed_text", f"""WITH {i.hashed('documents', 'doc_id', 'text', 'dv', 256)} SELECT CAST(w.k AS VARCHAR) AS doc_id,
    CAST(b AS INT) AS bucket, round(w / norm, 6) AS weight FROM dv_w w JOIN dv_n n ON n.k = w.k WHERE w <> 0""")
def embed_text(spark, sf):
    made = i.documents(spark, sf).select("doc_id", hash_embed("text_content", 256).alias("vec"))
    return _weights(made, "doc_id", "vec", 256)


@query("unit_vectors", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v,
    sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM embeddings)
    SELECT CAST(vec_id AS VARCHAR) AS doc_id, CAST(pos AS INT) AS bucket, round(x / norm, 6) AS weight FROM (
    SELECT vec_id, norm, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM e) WHERE x <> 0""")
def unit_vectors(spark, sf):
    return _weights(i.vectors(spark, sf).withColumn("vec", unit("embedding")), "doc_id", "vec", DIM)


# Vectors as text: size and first elements decide the repairs, the sum identifies the content.
def _mark(df):
    e = F.col("embedding")
    return df.select(
        "doc_id", F.coalesce(F.size(e), F.lit(-1)).alias("n"),
        tidy(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), 5).alias("total"),
    )


def _marked(source, e="embedding"):
    return f"""SELECT doc_id, CAST(coalesce(len({e}), -1) AS INT) AS n,
    CASE WHEN {e} IS NOT NULL THEN round(coalesce(list_sum({e}), 0), 5) + 0.0 END AS total FROM {source}"""


@query("embed_backfill", f"""WITH {DIRTY}, {i.hashed('dirty', 'doc_id', 'text_content', 'hv')}, filled AS (SELECT d.doc_id,
    CASE WHEN coalesce(len(d.embedding), 0) = 0 AND length(text_content) > 0 THEN coalesce(h.vec, d.embedding)
    ELSE d.embedding END AS embedding FROM dirty d LEFT JOIN hv h ON h.k = d.doc_id) {_marked('filled')}""")
def embed_backfill(spark, sf):
    return _mark(c.embed_backfill(i.dirty(spark, sf), DIM))


@query("repair_embeddings", f"""WITH {DIRTY}, {i.hashed('dirty', 'doc_id', 'text_content', 'hv')}, filled AS (SELECT d.doc_id,
    CASE WHEN len(d.embedding) = 64 THEN d.embedding ELSE h.vec END AS embedding
    FROM dirty d LEFT JOIN hv h ON h.k = d.doc_id) {_marked('filled')}""")
def repair_embeddings(spark, sf):
    return _mark(c.repair_embeddings(i.dirty(spark, sf), DIM))


@query("repair_report", f"""WITH {DIRTY}, {i.hashed('dirty', 'doc_id', 'text_content', 'hv')}, filled AS (SELECT d.doc_id,
    text_content, CASE WHEN len(d.embedding) = 64 THEN d.embedding ELSE h.vec END AS embedding
    FROM dirty d LEFT JOIN hv h ON h.k = d.doc_id) SELECT count(*) AS total_docs,
    count(text_content) AS has_content, count(embedding) AS valid_embeddings,
    count(*) FILTER (text_content IS NOT NULL AND embedding IS NULL) AS missing_embeddings,
    0::BIGINT AS empty_embeddings, 0::BIGINT AS wrong_dimension,
    count(*) FILTER (text_content IS NOT NULL AND embedding IS NULL) = 0 AND count(text_content) = count(embedding)
    AS passed FROM filled""")
def repair_report(spark, sf):
    return q.verify_embeddings(c.repair_embeddings(i.dirty(spark, sf), DIM), DIM)


@query("clear_embeddings", f"WITH {DOCS} SELECT doc_id, -1::INT AS n, NULL::DOUBLE AS total FROM docs")
def clear_embeddings(spark, sf):
    return _mark(c.clear_embeddings(i.dirty(spark, sf)))


@query("set_embedding", f"""WITH {CORPUS}, o AS (SELECT doc_id,
    CASE WHEN doc_id = '42' THEN [0.5::DOUBLE, 0.25] ELSE embedding END AS embedding FROM corpus) {_marked('o')}""")
def set_embedding(spark, sf):
    return _mark(c.set_embedding(i.corpus(spark, sf), "42", [0.5, 0.25]))


@query("fix_empty", f"""WITH {DIRTY}, o AS (SELECT doc_id,
    CASE WHEN len(embedding) > 0 THEN embedding END AS embedding FROM dirty) {_marked('o')}""")
def fix_empty(spark, sf):
    return _mark(c.fix_empty(i.dirty(spark, sf)))


@query("fix_dims", f"""WITH {DIRTY}, o AS (SELECT doc_id,
    CASE WHEN NOT (len(embedding) > 0 AND len(embedding) <> 64) THEN embedding END AS embedding FROM dirty)
    {_marked('o')}""")
def fix_dims(spark, sf):
    return _mark(c.fix_dims(i.dirty(spark, sf), DIM))


@query("wrong_dims", f"""WITH {DIRTY} SELECT modality, count(*) AS count FROM dirty
    WHERE len(embedding) > 0 AND len(embedding) <> 64 GROUP BY modality""")
def wrong_dims(spark, sf):
    return q.wrong_dims_by_modality(i.dirty(spark, sf), DIM)


@query("write_embeddings", f"""WITH {DIRTY}, o AS (SELECT d.doc_id, CASE WHEN e.vec_id IS NOT NULL
    THEN CAST(e.embedding AS DOUBLE[]) ELSE d.embedding END AS embedding FROM dirty d
    LEFT JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = d.doc_id) {_marked('o')}""")
def write_embeddings(spark, sf):
    return _mark(c.write_embeddings(i.dirty(spark, sf), i.vectors(spark, sf)))


@query("needs_embedding", f"""WITH {DIRTY} SELECT doc_id, CAST(length(text_content) AS INT) AS text_length FROM dirty
    WHERE coalesce(len(embedding), 0) = 0 AND length(text_content) > 0""")
def needs_embedding(spark, sf):
    rows = i.dirty(spark, sf).where(c.needs_embedding())
    return rows.select("doc_id", F.length("text_content").alias("text_length"))


@query("pending_documents", f"""WITH {DIRTY} SELECT doc_id, text_content, CAST(length(text_content) AS INT) AS text_length,
    {stamp_sql()} AS created FROM dirty WHERE coalesce(len(embedding), 0) = 0 AND length(text_content) > 0
    ORDER BY created_at DESC, doc_id LIMIT 100""")
def pending_documents(spark, sf):
    return c.pending(i.dirty(spark, sf), 100).select(
        "doc_id", "text_content", "text_length", i.stamp("created_at").alias("created")
    )


# --- streams -----------------------------------------------------------------------------------------


@query("incremental_corpus", f"""WITH {CHUNKS}, {i.hashed('assembled', 'doc_id', 'text_content', 'hv')}
    SELECT a.doc_id, a.uri, a.chunk_index, CAST(length(a.text_content) AS INT) AS chars,
    CAST(coalesce(len(h.vec), -1) AS INT) AS n FROM assembled a LEFT JOIN hv h ON h.k = a.doc_id""")
def incremental_corpus(spark, sf):
    """Documents read as a stream, chunked, embedded and appended; a second run finds nothing new."""
    root = i.work_dir(spark)
    batch = i.documents(spark, sf)
    raw = i.table(spark, sf, "documents")
    for n in range(2):
        # A pattern, as a stream's own path must be a folder and the table may be one file or a folder of many.
        source = spark.readStream.schema(raw.schema).parquet(f"{sf}/documents.parque[t]")
        docs = source.select(*i._doc_columns()).withColumns(
            {x: F.lit(None).cast(t) for x, t in (
                ("chunk_index", "long"), ("chunk_start", "long"), ("chunk_end", "long"), ("embedding", "array<double>"))}
        ).select(*batch.columns, "chunk_index", "chunk_start", "chunk_end", "embedding")
        # The second run has lost its checkpoint and reads everything again.
        feed_corpus(docs, f"{root}/corpus", f"{root}/checkpoint{n}", Settings(dim=DIM)).awaitTermination()
    rows = spark.read.parquet(f"{root}/corpus")
    return rows.select(
        "doc_id", "uri", "chunk_index", F.length("text_content").alias("chars"),
        F.coalesce(F.size("embedding"), F.lit(-1)).alias("n"),
    )


@query("near_copies", f"""WITH {i.hashed('documents', 'doc_id', 'text', 'dv', 256)}, u AS (SELECT vec,
    min(CAST(k AS VARCHAR)) AS id, count(*) AS copies FROM (SELECT k, list_transform(vec, lambda x: round(x, 12)) AS vec
    FROM dv) GROUP BY vec) SELECT a.id AS doc1, b.id AS doc2, a.copies AS copies1, b.copies AS copies2,
    round(list_cosine_similarity(a.vec, b.vec), 5) AS similarity FROM u a JOIN u b ON a.id < b.id
    WHERE round(1 - list_cosine_similarity(a.vec, b.vec), 9) < 0.02""")
def near_copies(spark, sf):
    """Near copies among the documents: equal vectors are listed once with their number of copies."""
    made = i.documents(spark, sf).select("doc_id", hash_embed("text_content", 256).alias("embedding"))
    # Vectors are made once and stored; every later step reads the stored groups.
    path = i.work_dir(spark) + "/groups"
    knn.distinct_vectors(made).write.parquet(path)
    groups = spark.read.parquet(path)
    pairs = knn.near_pairs(groups, 0.02, 256)
    n = groups.select("doc_id", "copies")
    one = n.select(F.col("doc_id").alias("doc1"), F.col("copies").alias("copies1"))
    two = n.select(F.col("doc_id").alias("doc2"), F.col("copies").alias("copies2"))
    return pairs.join(one, "doc1").join(two, "doc2").select(
        "doc1", "doc2", "copies1", "copies2", F.round("similarity", 5).alias("similarity")
    )
