"""The listing data source against Spark's own listing."""

import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from semcorpus.sources import listing
from semcorpus.sources.objects import classify, scan_objects


@pytest.fixture
def root(tmp_path):
    for n in range(30):
        folder = tmp_path / "files" / f"p{n % 4}" / f"deep{n % 2}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{n}{['.txt', '.PDF', '.md', '.xyz', ''][n % 5]}").write_text("x" * (n + 1))
    (tmp_path / "files" / "top.csv").write_text("a,b")
    (tmp_path / "files" / "_hidden.txt").write_text("no")
    return str(tmp_path / "files")


def rows(df):
    return sorted((r["uri"].removeprefix("file:"), r["size"], r["content_type"], r["updated"]) for r in df.collect())


def test_same_rows_as_the_scan(spark, root):
    mine = listing.list_objects(spark, root)
    want = scan_objects(spark, root, content=False)
    # Spark keeps times to the millisecond.
    cut = lambda df: df.withColumn("updated", F.date_trunc("MILLISECOND", "updated"))
    assert rows(cut(mine)) == rows(cut(want)) and mine.count() == 31
    assert mine.rdd.getNumPartitions() == 5
    said = {(r["uri"], r["modality"]) for r in mine.collect()}
    assert said == {(r["uri"], r["modality"]) for r in classify(mine.drop("modality")).collect()}


def test_filters_on_the_modality_are_taken(spark, root):
    for df in (listing.list_objects(spark, root).where("modality = 'pdf'"), listing.list_objects(spark, root, "pdf"), listing.list_objects(spark, root).where(F.col("modality").isin("pdf", "csv")).where("modality <> 'csv'")):
        assert {r["modality"] for r in df.collect()} == {"pdf"} and df.count() == 6
    reader = listing.ListingReader({"path": root})
    left = list(reader.pushFilters([listing.EqualTo(("modality",), "pdf"), listing.EqualTo(("size",), 3)]))
    assert reader.walk.wanted == {"pdf"} and len(left) == 1


def test_stream_sees_each_file_once(spark, root, tmp_path):
    old = time.time() - 60
    for p in Path(root).rglob("*"):
        os.utime(p, (old, old))
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        query = listing.stream_listing(spark, root, "text").writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.parquet(out).count()

    assert run() == 6 and run() == 6
    new = Path(root, "p9")
    new.mkdir()
    (new / "late.txt").write_text("late")
    os.utime(new / "late.txt", (old + 30, old + 30))
    # A file whose time lies before the last batch is not new to the stream.
    assert run() == 6
    now = time.time()
    (new / "later.txt").write_text("later")
    time.sleep(max(0.0, listing.SETTLED + 0.5 - (time.time() - now)))
    assert run() == 7


def test_odd_roots(spark, tmp_path):
    assert listing.list_objects(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="path"):
        listing.list_objects(spark, "").count()
