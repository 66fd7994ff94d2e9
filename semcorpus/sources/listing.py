"""Listings of files as a data source of their own: the tasks list, not the driver, and nothing is read but the listing.

The driver looks at the first level below the root only. Each folder there is one partition, and files beside them are one
more; a task walks its folder. A filter on the modality drops names before their size is asked for. As a stream, a batch
holds the files that were last changed after the one before, up to a moment that lies `SETTLED` in the past.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition

from semcorpus.settings import MIME_TYPES, MODALITY_EXTENSIONS

COLUMNS = "uri string, size long, content_type string, updated timestamp, generation string, modality string"
# Seconds after which a file's time of change is taken to be final.
SETTLED = 2.0
MODALITY_OF = {e: m for m, found in MODALITY_EXTENSIONS.items() for e in found}


@dataclass
class Prefix(InputPartition):
    """One folder to walk, or the files directly in it; only changes after `start` and up to `end`, in microseconds."""

    path: str
    deep: bool
    start: int | None = None
    end: int | None = None


def _split(root: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of a root, its path there, and what stands before paths in a uri."""
    fs, path = pafs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
    head = "" if root.startswith("/") else "file:" if root.startswith("file:") else root.partition("://")[0] + "://"
    return fs, path.rstrip("/"), head


def _extension(name: str) -> str:
    dot = name.rfind(".")
    return name[dot:].lower() if dot >= 0 else ""


class Walk:
    """Shared by the table and the stream."""

    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("a listing needs a path")
        self.root = options["path"]
        self.wanted = set(options["modality"].split(",")) if options.get("modality") else None

    def prefixes(self, start: int | None = None, end: int | None = None) -> list[Prefix]:
        fs, path, _ = _split(self.root)
        below = fs.get_file_info(pafs.FileSelector(path, recursive=False, allow_not_found=True))
        folders = sorted(f.path for f in below if f.type == pafs.FileType.Directory)
        return [Prefix(path, False, start, end), *[Prefix(f, True, start, end) for f in folders]]

    def files(self, prefix: Prefix) -> Iterator[tuple]:
        fs, _, head = _split(self.root)
        for f in fs.get_file_info(pafs.FileSelector(prefix.path, recursive=prefix.deep, allow_not_found=True)):
            if f.type != pafs.FileType.File:
                continue
            name = f.path.rsplit("/", 1)[-1]
            # Spark's readers pass over such files too.
            if name.startswith(("_", ".")):
                continue
            modality = MODALITY_OF.get(_extension(name))
            if self.wanted is not None and modality not in self.wanted:
                continue
            at = f.mtime_ns // 1000
            if (prefix.start is not None and at <= prefix.start) or (prefix.end is not None and at > prefix.end):
                continue
            updated = datetime.fromtimestamp(at / 1e6, timezone.utc)
            yield head + f.path, f.size, MIME_TYPES.get(_extension(name)), updated, None, modality


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.walk = Walk(options)

    def pushFilters(self, filters):
        """Takes filters on the modality; Spark keeps the others."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("modality",):
                self.walk.wanted = values if self.walk.wanted is None else self.walk.wanted & values
            else:
                yield f

    def partitions(self):
        return self.walk.prefixes()

    def read(self, partition: Prefix) -> Iterator[tuple]:
        return self.walk.files(partition)


class ListingStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.walk = Walk(options)

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        return {"until": int((time.time() - SETTLED) * 1e6)}

    def partitions(self, start: dict, end: dict):
        return self.walk.prefixes(start["until"], end["until"])

    def read(self, partition: Prefix) -> Iterator[tuple]:
        return self.walk.files(partition)


class ObjectListing(DataSource):
    """Options: path, and modality (several with commas)."""

    @classmethod
    def name(cls) -> str:
        return "object_listing"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> ListingReader:
        return ListingReader(dict(self.options))

    def streamReader(self, schema) -> ListingStream:
        return ListingStream(dict(self.options))


def list_objects(spark: SparkSession, root: str, modality: str | None = None) -> DataFrame:
    """Files under root with size, type, time and modality; folders below root are listed in parallel.

    For file systems that pyarrow can open; scan_objects reads through Spark's own.
    """
    spark.dataSource.register(ObjectListing)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("object_listing").option("path", root)
    return (reader if modality is None else reader.option("modality", modality)).load()


def stream_listing(spark: SparkSession, root: str, modality: str | None = None) -> DataFrame:
    """The same as a stream: each batch has the files changed since the last."""
    spark.dataSource.register(ObjectListing)
    reader = spark.readStream.format("object_listing").option("path", root)
    return (reader if modality is None else reader.option("modality", modality)).load()
