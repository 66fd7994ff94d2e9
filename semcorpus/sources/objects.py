"""Files as object tables: uri, size, content_type, updated, generation, data."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semcorpus.functions.text import col
from semcorpus.settings import MIME_TYPES, MODALITY_EXTENSIONS, MODALITY_SOURCES


def _lookup(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def extension(uri: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(uri), r"\.[^./]+$", 0))


def modality_of(uri: Column | str) -> Column:
    """Modality by file extension, NULL when unknown."""
    return F.try_element_at(
        _lookup({e: m for m, found in MODALITY_EXTENSIONS.items() for e in found}), extension(uri)
    )


def source_of(uri: Column | str) -> Column:
    return F.try_element_at(_lookup(MODALITY_SOURCES), modality_of(uri))


def media_type(uri: Column | str) -> Column:
    return F.try_element_at(_lookup(MIME_TYPES), extension(uri))


def classify(df: DataFrame, uri: str = "uri") -> DataFrame:
    return df.withColumns({"modality": modality_of(uri), "source": source_of(uri)})


def _glob(modality: str) -> str:
    names = ",".join(e.lstrip(".") for e in MODALITY_EXTENSIONS[modality])
    return "*.{" + names + "}"


def _as_objects(files: DataFrame, content: bool) -> DataFrame:
    kept = [
        F.col("path").alias("uri"),
        F.col("length").alias("size"),
        media_type("path").alias("content_type"),
        F.col("modificationTime").alias("updated"),
        F.lit(None).cast("string").alias("generation"),
    ]
    return files.select(*kept, *([F.col("content").alias("data")] if content else []))


def scan_objects(
    spark: SparkSession, root: str, modality: str | None = None, content: bool = True
) -> DataFrame:
    """Files under root, of one modality if given. Without content only the listing is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if modality is not None:
        reader = reader.option("pathGlobFilter", _glob(modality))
    return _as_objects(reader.load(root), content)


def stream_objects(
    spark: SparkSession, root: str, modality: str | None = None, files_per_batch: int = 10_000
) -> DataFrame:
    """The same rows as a stream that sees each file once."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
    )
    if modality is not None:
        reader = reader.option("pathGlobFilter", _glob(modality))
    return _as_objects(reader.load(root), True)
