"""The registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from semcorpus.llm import byte_bpe, collocations, conversation_repair, decontaminate, embedding_dedup, language_id, lm_scoring, minhash_dedup, oracles, pii, secret_scan, token_counts, toxicity, url_filter
from semcorpus.llm.batches import few_rows, fold, small_batches
from semcorpus.plans.registry import Query

QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = Query(run, sql)
        return run

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op10_decontaminate", oracles.OP10)
def op10_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.shared_words(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "longest",
    )


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held = fold(F.col("doc_id"), 3) == 1
    model = language_id.train(docs.where(~held), "text", "lang", F.col("doc_id"))
    found = language_id.identified(docs, model)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["stop"])), ",")


def _is(kind: str):
    return lambda s: s["kind"] == kind


@query("op9_secret_scan")
def op9_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = secret_scan.scanned(table(spark, sf, "documents"))
    found = found.withColumn("base", F.filter("secrets", lambda s: s["layer"] == ""))
    count = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in secret_scan.KINDS]
    return found.select("doc_id", *count, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("secrets").alias("spans"))


@query("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    vocab = byte_bpe.default_vocabulary()
    encoded = byte_bpe.encode(table(spark, sf, "documents"), vocab)
    return byte_bpe.decode(encoded, vocab).mapInArrow(
        _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def _digests(batches):
    name = [str(i) for i in range(1 << 16)]
    for batch in batches:
        for part in few_rows(batch):
            ids = part.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(",".join([name[i] for i in x]).encode()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in part.column(2).to_pylist()]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )


@query("op6_minhash_dedup", oracles.OP6)
def op6_minhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf, "documents"), percent=85)


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf, "documents"), token_counts.default_tokenizer())
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


_FITS = """CASE WHEN (h = 'example.org' OR h LIKE '%.example.org') AND p LIKE '/en/1%' THEN 'example.org/en/1'
  WHEN (h = 'example.org' OR h LIKE '%.example.org') AND p LIKE '/es/%' THEN 'example.org/es/'
  WHEN (h = 'com' OR h LIKE '%.com') AND p LIKE '/fr/%' THEN 'com/fr/'
  WHEN (h = 'com' OR h LIKE '%.com') AND p LIKE '/de/%' THEN 'com/de/'
  WHEN (h = 'org' OR h LIKE '%.org') AND p LIKE '/%' THEN 'org/' END"""
OP2_SQL = f"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{url_filter.UPPER}', '{url_filter.LOWER}') AS h,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS p
  FROM pages),
fits AS (SELECT *, {_FITS} AS r FROM parts)
SELECT page_id, h AS host, p AS path, r AS rule,
  CASE WHEN r IN ('org/', 'com/fr/') THEN 'allow' WHEN r IS NOT NULL THEN 'block'
    WHEN regexp_matches('.' || h || p, '^[^/]*[.]ads(-track)?[.]') OR regexp_matches('.' || h || p, '/ads/') THEN 'block'
    ELSE 'allow' END AS verdict
FROM fits"""


@query("op2_url_filter", OP2_SQL)
def op2_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judged(table(spark, sf, "pages"))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    held = fold(F.col("doc_id"), 4) == 2
    model = toxicity.train(docs, labels.where(~held))
    found = toxicity.scored(docs, model)
    return found.select(
        "doc_id",
        F.coalesce(held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.size("sentences").alias("n_sentences"),
    )


@query("op1_lm_scoring")
def op1_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    counts = lm_scoring.word_counts(docs)
    memory = lm_scoring.contexts(docs)
    return lm_scoring.scored(docs, *lm_scoring.train(docs, counts=counts), counts=counts, memory=memory)


@query("op5_embedding_dedup", oracles.OP5)
def op5_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_dedup.linked_vectors(table(spark, sf, "embeddings"), least=0.95)


@query("op11_conversation_repair", oracles.OP11)
def op11_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    talks = table(spark, sf, "conversations")
    found = conversation_repair.reports(conversation_repair.damaged(talks)).withColumnRenamed("conv_id", "c")
    ids = talks.select("conv_id").distinct()
    found = ids.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    none = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return found.select("conv_id", *[F.coalesce(c, none.get(c, F.lit(0).cast("long"))).alias(c) for c in found.columns[1:]])


@query("op12_collocations", oracles.OP12)
def op12_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"))


@query("op13_pii")
def op13_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.scanned(table(spark, sf, "documents"))
    found = found.withColumn("base", F.filter("spans", lambda s: s["plain"]))
    count = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *count, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
