"""The given tables as corpus, object, annotation and media inputs, in Spark and in SQL.

Every input is a whole table: nothing is sampled or cut.
"""

from __future__ import annotations

import uuid
from datetime import datetime
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semcorpus.operators.knn import mean_vectors
from semcorpus.operators.media import running_before, shot_order, speech_result_table
from semcorpus.session import shared_dir

DIM = 64
NOW = datetime(2024, 6, 1)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A fresh folder under the shared one."""
    return f"{shared_dir(spark)}/semcorpus-{uuid.uuid4().hex}"


def stamp(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _pick(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))


def doc_uri(doc_id: Column, source: Column) -> Column:
    ext = _pick([".txt", ".md", ".pdf", ".jpg"], doc_id % 4)
    return F.concat(F.lit("file:///corpus/"), source, F.lit("/"), doc_id.cast("string"), ext)


def _doc_columns() -> list[Column]:
    d = F.col("doc_id")
    return [
        d.cast("string").alias("doc_id"),
        doc_uri(d, F.col("source")).alias("uri"),
        _pick(["text", "markdown", "pdf", "image"], d % 4).alias("modality"),
        F.col("source"),
        F.timestamp_seconds(F.lit(1704067200) + d * 3600).alias("created_at"),
        F.lit(None).cast("string").alias("author"),
        F.lit(None).cast("string").alias("channel"),
        F.col("text").alias("text_content"),
        F.lit("text/plain").alias("mime_type"),
        F.concat(F.lit('{"lang":"'), F.col("lang"), F.lit('"}')).alias("meta"),
    ]


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without vectors."""
    return table(spark, sf, "documents").select(*_doc_columns())


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the given vector of the same number, where there is one."""
    docs = table(spark, sf, "documents")
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    return docs.join(e, "doc_id", "left").select(*_doc_columns(), "embedding")


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus with missing, empty and short vectors and missing texts; vectors from the text's own number."""
    n = F.col("doc_id").cast("long")
    e = F.col("embedding")
    return corpus(spark, sf).withColumns(
        {
            "embedding": F.when(n % 10 == 9, F.lit(None).cast("array<double>"))
            .when(n % 10 == 8, F.array().cast("array<double>"))
            .when(n % 10 == 7, F.slice(e, 1, 32)).otherwise(e),
            "text_content": F.when(n % 50 != 0, F.col("text_content")),
        }
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("doc_id"),
        F.col("embedding").cast("array<double>").alias("embedding"), "label",
    )


def topics(spark: SparkSession, sf: str) -> DataFrame:
    """One query per label: the mean of all its vectors."""
    return mean_vectors(vectors(spark, sf), "label").select(
        F.concat(F.lit("topic "), F.col("label").cast("string")).alias("query_id"), F.col("vec").alias("q"), "label"
    )


@lru_cache(maxsize=256)
def topic(spark: SparkSession, sf: str, label: int = 3) -> tuple[float, ...]:
    """One query vector; remembered, as a caller would keep an embedded query."""
    return tuple(topics(spark, sf).where(F.col("label") == label).first()["q"])


@lru_cache(maxsize=16)
def centroids(spark: SparkSession, sf: str):
    """The topic vectors as a matrix, in label order."""
    import numpy as np

    rows = topics(spark, sf).select("label", "q").orderBy("label").collect()
    return np.array([r["q"] for r in rows])


def objects(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files: their bytes, size, type and time."""
    d = table(spark, sf, "documents")
    text = F.col("text")
    return d.select(
        doc_uri(F.col("doc_id"), F.col("source")).alias("uri"),
        F.octet_length(text).cast("long").alias("size"),
        F.lit("text/plain").alias("content_type"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600).alias("updated"),
        F.lit(None).cast("string").alias("generation"),
        F.encode(text, "utf-8").alias("data"),
        "doc_id", "source",
    )


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as user annotations, some of them partial."""
    lab = table(spark, sf, "labels")
    d = table(spark, sf, "documents").select("doc_id", "source")
    q, t = F.col("quality").cast("string"), F.col("toxic")
    return lab.join(d, "doc_id").select(
        doc_uri(F.col("doc_id"), F.col("source")).alias("uri"),
        F.when(t == 0, F.concat(F.lit("Paper "), F.col("doc_id").cast("string"))).alias("title"),
        F.concat(F.lit("quality "), q).alias("description"),
        F.when(F.col("quality") == 1, "research").alias("category"),
        F.when(t == 0, F.array(F.concat(F.lit("q"), q), F.lit("labelled"))).alias("tags"),
    )


def seen(spark: SparkSession, sf: str, modality: str, source: str) -> DataFrame:
    """Documents already ingested: those labelled toxic."""
    lab = table(spark, sf, "labels").where(F.col("toxic") == 1)
    d = table(spark, sf, "documents").select("doc_id", "source")
    return lab.join(d, "doc_id").select(
        doc_uri(F.col("doc_id"), F.col("source")).alias("uri"), F.lit(modality).alias("modality"),
        F.lit(source).alias("source"),
    )


def speech_results(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation turn as one recognised result with timed words, half a second per word."""
    c = table(spark, sf, "conversations")
    parts = F.split("text", " ")
    based = running_before(c, "conv_id", F.floor(F.col("turn") / 1000), ["turn"], F.size(parts), "__base")

    def word(w: Column, i: Column) -> Column:
        start = (F.col("__base") + i) * 0.5
        return F.struct(
            w.alias("word"), start.alias("start_time"), (start + 0.5).alias("end_time"),
            F.col("role").alias("speaker_id"), (F.lit(0.5) + F.col("turn") % 5 / 10).alias("confidence"),
        )

    return based.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("media_id"),
        F.col("turn").alias("result_no"),
        F.transform(parts, word).alias("words"),
        F.col("text").alias("transcript"),
        F.when(F.col("turn") % 3 == 0, 0.0).otherwise(F.lit(0.5) + F.col("turn") % 5 / 10).alias("confidence"),
    )


def spoken(spark: SparkSession, sf: str) -> DataFrame:
    return speech_result_table(speech_results(spark, sf))


def shots(spark: SparkSession, sf: str) -> DataFrame:
    """Events as shots: one video per user, time shrunk a thousandfold, the value as the length."""
    e = table(spark, sf, "events")
    start = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / F.lit(1e9)
    raw = e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("video_id"),
        F.col("event_id").alias("shot_index"), start.alias("start_time"),
        (start + F.col("value")).alias("end_time"),
    )
    return shot_order(raw)


def media(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors as transcripts (labels 0-3), on-screen texts (4-6) and segments (7-9) of seven videos."""
    v = vectors(spark, sf)
    n = F.col("doc_id").cast("long")
    video = F.concat(F.lit("v"), (n % 7).cast("string"))
    shared = [video.alias("video_id"), F.concat(F.lit("file:///video/"), video, F.lit(".mp4")).alias("uri")]
    at = (n % 20).cast("double")
    said = v.where("label between 0 and 3").select(
        F.concat(F.lit("t"), "doc_id").alias("transcript_id"), *shared, at.alias("start_time"),
        (at + 2).alias("end_time"), F.concat(F.lit("spoken "), "doc_id").alias("text"),
        F.col("label").cast("string").alias("speaker_id"), F.col("embedding").alias("text_embedding"),
    )
    shown = v.where("label between 4 and 6").select(
        F.concat(F.lit("o"), "doc_id").alias("ocr_id"), *shared, at.alias("frame_time"),
        F.concat(F.lit("shown "), (n % 11).cast("string")).alias("text"), F.col("embedding").alias("text_embedding"),
    )
    cut = v.where("label between 7 and 9").select(
        F.concat(F.lit("s"), "doc_id").alias("segment_id"), *shared, at.alias("start_time"),
        (at + 3).alias("end_time"), F.concat(F.lit("shot_"), "doc_id").alias("shot_label"),
        F.col("embedding").alias("visual_embedding"),
    )
    return said, shown, cut


# --- the same inputs in SQL --------------------------------------------------------------------------

_URI = "'file:///corpus/' || d.source || '/' || d.doc_id || ['.txt','.md','.pdf','.jpg'][d.doc_id % 4 + 1]"
_DOC = f"""CAST(d.doc_id AS VARCHAR) AS doc_id, {_URI} AS uri,
    ['text','markdown','pdf','image'][d.doc_id % 4 + 1] AS modality, d.source AS source,
    TIMESTAMP '2024-01-01' + to_hours(d.doc_id) AS created_at, d.text AS text_content,
    '{{"lang":"' || d.lang || '"}}' AS meta, d.doc_id AS n"""
DOCS = f"docs AS (SELECT {_DOC} FROM documents d)"
CORPUS = f"""corpus AS (SELECT {_DOC}, CAST(e.embedding AS DOUBLE[]) AS embedding
    FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""
DIRTY = f"""{CORPUS}, dirty AS (SELECT doc_id, uri, modality, source, created_at, n,
    CASE WHEN n % 50 <> 0 THEN text_content END AS text_content,
    CASE n % 10 WHEN 9 THEN NULL WHEN 8 THEN CAST([] AS DOUBLE[]) WHEN 7 THEN embedding[1:32] ELSE embedding END
        AS embedding FROM corpus)"""
TOPICS = """topics AS (SELECT label, 'topic ' || label AS query_id, list(a ORDER BY pos) AS q FROM (
    SELECT label, pos, avg(x) AS a FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x,
    generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label)"""
OBJECTS = f"""objects AS (SELECT {_URI} AS uri, CAST(strlen(d.text) AS BIGINT) AS size, 'text/plain' AS content_type,
    TIMESTAMP '2024-01-01' + to_hours(d.doc_id) AS updated, d.text AS text, d.doc_id, d.source FROM documents d)"""
ANNOTATIONS = f"""annotations AS (SELECT {_URI} AS uri, CASE WHEN toxic = 0 THEN 'Paper ' || d.doc_id END AS title,
    'quality ' || quality AS description, CASE WHEN quality = 1 THEN 'research' END AS category,
    CASE WHEN toxic = 0 THEN 'q' || quality || ', labelled' END AS tags
    FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""
SEEN = f"""seen AS (SELECT {_URI} AS uri FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE toxic = 1)"""
SHOTS = """shots AS (SELECT 'u' || user_id AS video_id,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS shot_index,
    (epoch_us(ts) - 1704067200000000) / 1e9 AS start_time,
    (epoch_us(ts) - 1704067200000000) / 1e9 + value AS end_time FROM events)"""
WORDS = """turns AS (SELECT conv_id, turn, role, string_split(text, ' ') AS parts,
    coalesce(sum(len(string_split(text, ' '))) OVER (PARTITION BY conv_id ORDER BY turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM conversations),
    words AS (SELECT 'c' || conv_id AS media_id, turn, role AS speaker_id, unnest(parts) AS word,
    generate_subscripts(parts, 1) - 1 AS word_no,
    CAST((base + generate_subscripts(parts, 1) - 1) * 0.5 AS DOUBLE) AS start_time,
    0.5 + turn % 5 / 10.0 AS confidence FROM turns)"""


def near(label: int = 3, source: str = "corpus") -> str:
    return f"""near AS (SELECT c.*, round(1 - list_cosine_similarity(c.embedding, t.q), 9) + 0.0 AS distance
    FROM {source} c, topics t WHERE t.label = {label} AND c.embedding IS NOT NULL)"""


def stamp_sql(c: str = "created_at") -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def hashed(source: str, key: str, text: str, name: str, dim: int = DIM) -> str:
    """The hashed unit vector of a text column as a list, as CTEs name_w (token weights) and name."""
    return f"""{name}_w AS (SELECT k, ('0x' || substr(md5(t), 1, 8))::BIGINT % {dim} AS b,
        sum(CASE WHEN ('0x' || substr(md5(t), 9, 1))::INT % 2 = 0 THEN 1 ELSE -1 END) AS w FROM (
        SELECT {key} AS k, unnest(list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'),
            lambda t: t <> '')) AS t FROM {source}) GROUP BY 1, 2),
    {name}_n AS (SELECT k, sqrt(sum(w * w)) AS norm FROM {name}_w GROUP BY k HAVING sum(w * w) > 0),
    {name} AS (SELECT g.k, list(coalesce(v.w, 0) / g.norm ORDER BY g.b) AS vec FROM (
        SELECT k, norm, unnest(range({dim})) AS b FROM {name}_n) g
        LEFT JOIN {name}_w v ON v.k = g.k AND v.b = g.b GROUP BY g.k)"""
