"""The stream of documents over tables kept as one file and as a folder of files."""

import pytest
from pyspark.sql import functions as F

from semcorpus.plans import catalog


@pytest.mark.parametrize("files", [1, 3])
def test_incremental_corpus_reads_a_folder_of_files(spark, scratch, files):
    rows = spark.range(30).select(
        F.col("id").alias("doc_id"), F.format_string("text number %d", "id").alias("text"), F.lit("en").alias("lang"),
        F.lit("web").alias("source"), F.lit(10).cast("long").alias("n_chars"),
    )
    rows.repartition(files).write.parquet(f"{scratch}/documents.parquet")
    got = catalog.QUERIES["incremental_corpus"].run(spark, scratch).collect()
    assert sorted(int(r["doc_id"]) for r in got) == list(range(30))
    assert {(r["chunk_index"], r["n"]) for r in got} == {(None, 64)}
