"""New files and new documents as streams that run until nothing is left.

A checkpoint remembers what was read. The stream of files keeps the ids it has seen in keyed state and honours batch
numbers, so a batch that is replayed adds nothing and no batch reads the output; only a batch that was broken off, and those
of a checkpoint younger than its table, are compared with what the table holds. The stream of documents skips ids that the days of its
batch already hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from semcorpus.operators.chunk import chunk_fixed, is_long
from semcorpus.operators.corpus import embed_backfill
from semcorpus.operators.ingest import ingest_text
from semcorpus.operators.known import drop_known
from semcorpus.settings import DEFAULTS, Settings
from semcorpus.sources.objects import stream_objects
from semcorpus.sources.schemas import DOCUMENT
from semcorpus.sources.tables import read_table, write_table
from semcorpus.sources.versions import fs_of

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _has_data(spark: SparkSession, path: str) -> bool:
    fs, folder = fs_of(spark, path)
    return fs.exists(folder)


def append_new(batch: DataFrame, path: str, key: str = "doc_id", days: tuple | None = None) -> None:
    """Append the rows whose key the table lacks.

    With days only those folders of the table are read: enough when a key always comes with the same
    created_at. Of the table's keys only those that may be in the batch are shuffled.
    """
    spark = batch.sparkSession
    fresh = batch.dropDuplicates([key])
    if _has_data(spark, path):
        held = read_table(spark, path, DOCUMENT)
        if days is not None:
            held = held.where(F.col("created_date").between(*[F.lit(d) for d in days]))
        fresh = drop_known(fresh, held, key)
    write_table(fresh, path)


class BatchSink:
    """Appends batches to a table, each once.

    Two marks beside the table say that a batch was begun and done. A batch that is done is not written again. One that was
    begun and not done may have left some of its rows, so it is compared with the table. So is every batch of a checkpoint
    that is younger than its table (a lost one, or rows from elsewhere), as its state does not know what is there. Any other
    batch is appended as it is: its ids are new by the state of the stream.
    """

    def __init__(self, path: str, checkpoint: str):
        self.path = path
        self.marks = f"{path}/_batches/{hashlib.md5(checkpoint.encode()).hexdigest()}"

    def _marked(self, spark: SparkSession, name: str, make: bool = False) -> bool:
        fs, file = fs_of(spark, f"{self.marks}/{name}")
        held = fs.exists(file)
        if make and not held:
            fs.create(file, False).close()
        return held

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if self._marked(spark, f"{number}.done"):
            return
        broken = self._marked(spark, f"{number}.begun")
        if number == 0 and not broken and _has_data(spark, self.path):
            self._marked(spark, "younger", make=True)
        self._marked(spark, f"{number}.begun", make=True)
        if broken or self._marked(spark, "younger"):
            append_new(batch, self.path)
        else:
            write_table(batch, self.path)
        self._marked(spark, f"{number}.done", make=True)


def ingest_stream(
    spark: SparkSession, root: str, out: str, checkpoint: str, modality: str = "text",
    reader: Callable[[DataFrame], DataFrame] = ingest_text, files_per_batch: int = 10_000,
) -> StreamingQuery:
    """Files that appeared under root since the last run, as documents appended to out.

    The ids seen so far are keyed state in RocksDB: on the disks of the executors and in the checkpoint, not in memory. A
    file that is written anew under a known uri is not taken again.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    documents = reader(stream_objects(spark, root, modality, files_per_batch)).dropDuplicates(["doc_id"])
    return (
        documents.writeStream.foreachBatch(BatchSink(out, checkpoint))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def corpus_rows(documents: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Chunks of long documents and short documents whole, embedded."""
    chunks = chunk_fixed(documents, settings.chunk_size, settings.chunk_overlap)
    text = F.col("text_content")
    short = documents.where(text.isNotNull() & ~is_long("text_content", settings.chunk_size))
    return embed_backfill(chunks.unionByName(short), settings.dim)


def corpus_stream(
    spark: SparkSession, documents_path: str, out: str, checkpoint: str, settings: Settings = DEFAULTS
) -> StreamingQuery:
    """New documents chunked, embedded and appended to the corpus at out."""
    return feed_corpus(
        spark.readStream.schema(read_table(spark, documents_path, DOCUMENT).schema).parquet(documents_path)
        .drop("created_date"),
        out, checkpoint, settings,
    )


def feed_corpus(documents: DataFrame, out: str, checkpoint: str, settings: Settings = DEFAULTS) -> StreamingQuery:
    """As corpus_stream, for any stream of documents."""

    def take(batch: DataFrame, _: int) -> None:
        day = F.to_date("created_at")
        days = batch.agg(F.min(day), F.max(day)).first()
        if days[0] is not None:
            append_new(corpus_rows(batch, settings), out, days=tuple(days))

    return (
        documents.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
