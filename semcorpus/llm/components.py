"""Connected components over links held in Spark, and the tables that cut their lineage."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semcorpus.session import shared_dir


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: lost executors repeat no earlier work."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Delete the folder of a table that `cut` made, once nothing reads it any more."""
    spark = table.sparkSession
    files = table.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0].rpartition("/")[0])
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every id in links a-b, and the smallest id it reaches."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(ids))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        np.minimum.at(label, before[x], low)
        np.minimum.at(label, before[y], low)
        label = label[label]
        if np.array_equal(label, before):
            return ids, ids[label]


def _thin(batches):
    """Links of a batch replaced by one link from each id to the smallest it reaches."""
    for batch in batches:
        if batch.num_rows:
            ids, root = roots(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            keep = ids != root
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(root[keep])], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(id, component): each id that some link (a, b) joins to a smaller one, with the smallest it reaches.

    Ids are longs. Smallest ids of a component, and ids without links, have no row. Alternates between linking
    larger and smaller neighbours to the smallest one, which needs a logarithmic number of rounds; each round
    is written to the shared folder.
    """
    now = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(_thin, "u long, v long")
    now, mark = cut(now.distinct()), None
    while True:
        said = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if said == mark or not said[0]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        mark = said
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that Spark can split the neighbours of a hub in the joins.
        first = least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        for done in (before, first, least):
            drop(done)
