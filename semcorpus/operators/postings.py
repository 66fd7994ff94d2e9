"""Keyword and pattern search from trigram postings, so that only texts that can match are read.

    postings/bucket=<n>/    (trigram, ids of some documents that hold it), sorted by trigram
    trigrams/               trigram, bucket and how many documents hold it

A text is lower-cased as the scan does it and cut into its distinct runs of three characters; a shorter text is one run.
A term of three characters or more can only stand where all its trigrams stand; a shorter one where some trigram holds it.
Candidates from the postings are checked on the texts, so results equal a scan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semcorpus.functions.text import keyword_match, keyword_score, query_terms
from semcorpus.operators.knn import HIT_BYTES
from semcorpus.settings import DEFAULTS, Settings

# Rarest trigrams of a term that are intersected; the texts decide about the rest.
RAREST = 4
# Texts cut at a time: bounds the Python objects of a task.
TEXTS = 256
# A character and one more in a number.
MASK = (1 << 21) - 1


def _names(runs: np.ndarray) -> pa.Array:
    """The characters of runs given as numbers."""
    chars = np.stack([runs >> 42, runs >> 21 & MASK, runs & MASK], axis=1)
    ends = np.cumsum((chars > 0).sum(axis=1)).tolist()
    text = (chars[chars > 0] - 1).astype("<u4").tobytes().decode("utf-32-le")
    return pa.array([text[a:b] for a, b in zip([0, *ends], ends)], pa.string())


def _runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of each text as numbers, in order, and which text each is of. A character, plus one, has 21 bits."""
    runs, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for k, text in enumerate(texts.to_pylist()):
        c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64) + 1
        if len(c) < 3:
            c = np.concatenate([c, np.zeros(3 - len(c), np.int64)])
        runs.append(np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]))
        owners.append(np.full(len(runs[-1]), k, np.int32))
    run, owner = np.concatenate(runs), np.concatenate(owners)
    order = np.argsort(run, kind="stable")
    return run[order], owner[order]


def build_postings(
    corpus: DataFrame, path: str, buckets: int = 64, id_col: str = "doc_id", text_col: str = "text_content"
) -> None:
    """Write the postings of every text. Null texts have none."""
    rows = corpus.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.lower(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType

    def cut(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                part = batch.slice(lo, TEXTS)
                run, owner = _runs(part.column(1))
                ends = np.flatnonzero(np.diff(run, append=-1)) + 1
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), part.column(0).take(pa.array(owner)))
                yield pa.RecordBatch.from_arrays([_names(run[ends - 1]), ids], names=["trigram", "ids"])

    # A trigram travels and is sorted once for all texts that are cut at a time.
    found = rows.mapInArrow(cut, T.StructType([T.StructField("trigram", T.StringType()), T.StructField("ids", T.ArrayType(kind))]))
    found = found.withColumn("bucket", F.pmod(F.xxhash64("trigram"), F.lit(buckets)).cast("int"))
    (
        found.hint("rebalance", "bucket").sortWithinPartitions("bucket", "trigram")
        .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    )
    held = corpus.sparkSession.read.parquet(f"{path}/postings")
    held.groupBy("trigram", "bucket").agg(F.sum(F.size("ids").cast("long")).alias("docs")).write.mode("overwrite").parquet(f"{path}/trigrams")


class Postings:
    """Postings written by build_postings."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings = DEFAULTS):
        self.spark, self.settings = spark, settings
        self.postings = spark.read.parquet(f"{path}/postings").select("trigram", "bucket", F.explode("ids").alias("doc_id"))
        self.trigrams = spark.read.parquet(f"{path}/trigrams")

    def _runs(self, term: str) -> list[tuple[str, int]] | None:
        """The rarest trigrams of a term with their buckets; None if one of them stands nowhere."""
        wanted = sorted({term[i:i + 3] for i in range(len(term) - 2)})
        found = self.trigrams.where(F.col("trigram").isin(wanted)).orderBy("docs", "trigram").collect()
        if len(found) < len(wanted):
            return None
        return [(r["trigram"], r["bucket"]) for r in found[:RAREST]]

    def candidates(self, term: str) -> DataFrame:
        """Ids (distinct) of the texts that can hold a lower-cased term; every text that holds it is among them."""
        none = self.postings.select("doc_id").where("false")
        if not term:
            return self.postings.select("doc_id").distinct()
        if len(term) > 2:
            runs = self._runs(term)
            if runs is None:
                return none
            # Folders by bucket, row groups by the sorted trigram.
            hits = self.postings.where(F.col("bucket").isin(sorted({b for _, b in runs})) & F.col("trigram").isin([t for t, _ in runs]))
            return hits.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") == len(runs)).select("doc_id")
        # A short term stands in many trigrams: those are joined, as their number is that of all trigrams with the term.
        holders = self.trigrams.where(F.contains("trigram", F.lit(term))).select("trigram", "bucket")
        return self.postings.join(holders, ["bucket", "trigram"], "left_semi").select("doc_id").distinct()

    def any_of(self, terms: Sequence[str]) -> DataFrame:
        """Ids of the texts that can hold at least one of some lower-cased terms."""
        out = None
        for term in dict.fromkeys(terms):
            found = self.candidates(term)
            out = found if out is None else out.unionByName(found)
        return out.distinct() if len(set(terms)) > 1 else out

    def _read(self, corpus: DataFrame, ids: DataFrame) -> DataFrame:
        """The rows of some ids. Few ids (they are counted up to a bound) travel to the rows."""
        room = self.settings.broadcast_bytes // HIT_BYTES
        few = ids.limit(room + 1).count() <= room
        return corpus.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    def keyword_search(self, corpus: DataFrame, query: str, k: int) -> DataFrame:
        """As keyword_search of the scan: rows that hold any term, by the share of terms they hold."""
        terms = query_terms(query)
        if not terms:
            raise ValueError("the query has no terms")
        rows = self._read(corpus, self.any_of(terms))
        return (
            rows.where(keyword_match("text_content", terms))
            .withColumn("keyword_score", keyword_score("text_content", terms))
            .select("doc_id", "uri", "modality", "source", "created_at", "author", "channel", "text_content", "keyword_score")
            .orderBy(F.col("keyword_score").desc(), "doc_id")
            .limit(k)
        )

    def matching(self, corpus: DataFrame, pattern: str) -> DataFrame:
        """Rows whose text matches a pattern. One that is a list of alternatives with plain words in them is answered from
        the postings; any other is a scan."""
        held: Column = F.rlike("text_content", F.lit(pattern))
        words = required(pattern)
        return (corpus if words is None else self._read(corpus, self.any_of(words))).where(held)


def required(pattern: str) -> list[str] | None:
    """Lower-cased words of which every match holds one: the longest plain run of each top-level alternative. None if an
    alternative has none, or the pattern has groups, classes or escapes that hide where an alternative ends."""
    body = re.sub(r"^\(\?i\)", "", pattern)
    if not body or re.search(r"[\\()\[\]{}]", body):
        return None
    out = []
    for way in body.split("|"):
        # A letter before ?, * or {} need not stand; dots and anchors are no letters.
        solid = re.sub(r".[?*]", "\0", way)
        runs = [r for r in re.split(r"[\0.^$+]", solid) if r]
        if not runs:
            return None
        best = max(runs, key=len)
        if not best.isascii():
            return None
        out.append(best.lower())
    return out
