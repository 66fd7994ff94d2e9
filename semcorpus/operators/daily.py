"""Corpus reports from sums kept by day, so that only days that changed are read again.

    <report>/sums/part=<name>/    per day, modality and source: counts, sums and latest times
    <report>/uris/part=<name>/    per day, modality and source: the distinct uris
    <report>/seen/    versions of what each day of the corpus looked like when it was summed, and the part that has its rows

A refresh writes one part. Days have no folders of their own here, as a folder takes longer to make than its few rows.

Counts, sums, maxima and sets of distinct uris of days merge into those of the corpus, so the reports equal a full scan.
"""

from __future__ import annotations

import hashlib
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semcorpus.functions.vectors import has_vector
from semcorpus.operators.quality import _share
from semcorpus.sources import versions as v
from semcorpus.sources.updates import read_days, state

KEYS = ("created_date", "modality", "source")
SEEN = "created_date date, mark string, part string"


def day_sums(rows: DataFrame) -> DataFrame:
    """One row per day, modality and source."""
    text, size = F.col("text_content"), F.nullif(F.size("embedding"), F.lit(0))
    return rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("documents"), F.count(text).alias("texts"), F.sum(F.length(text).cast("long")).alias("chars"),
        F.max("created_at").alias("latest"), F.count_if(has_vector("embedding")).alias("embedded"),
        F.count_if(has_vector("embedding") & text.isNotNull()).alias("texts_embedded"),
        F.sum(F.when(text.isNotNull(), size).cast("long")).alias("dims"),
        F.count(F.when(text.isNotNull(), size)).alias("dims_n"),
    )


class DailyReports:
    """Reports on the table at `path`, kept at `report`."""

    def __init__(self, spark: SparkSession, path: str, report: str):
        self.spark, self.path, self.report = spark, path, report

    def _marks(self, held: dict[date | None, list[str]]) -> dict[date | None, str]:
        """What each day looks like: its folders, with names and sizes of the files in those that can still grow."""
        out = {}
        for day, folders in held.items():
            said = []
            for folder in sorted(folders):
                said.append(folder)
                if not folder.startswith("_parts/"):
                    fs, place = v.fs_of(self.spark, f"{self.path}/{folder}")
                    said += sorted(f"{f.getPath().getName()}:{f.getLen()}" for f in fs.listStatus(place))
            out[day] = hashlib.md5("\n".join(said).encode()).hexdigest()
        return out

    def refresh(self) -> list[date | None]:
        """Sum the days that changed since the last time, and no others; returns them."""
        _, held = state(self.spark, self.path)
        now, known = self._marks(held), v.versions(self.spark, f"{self.report}/seen")
        before = {r["created_date"]: r for r in self._seen().collect()} if known else {}
        changed = [d for d in now if d not in before or before[d]["mark"] != now[d]]
        gone = [d for d in before if d not in now]
        if not changed and not gone:
            return []
        part = f"r{uuid.uuid4().hex}"
        if changed:
            rows = read_days(self.spark, self.path, changed, at=held)
            if "embedding" not in rows.columns:
                rows = rows.withColumn("embedding", F.lit(None).cast("array<double>"))
            day_sums(rows).write.parquet(f"{self.report}/sums/part={part}")
            rows.where("uri IS NOT NULL").select(*KEYS, "uri").distinct().write.parquet(f"{self.report}/uris/part={part}")
        # Last, so that a refresh that breaks off is done again.
        fresh = set(changed)
        seen = self.spark.createDataFrame([(d, m, part if d in fresh else before[d]["part"]) for d, m in now.items()], SEEN)
        v.commit(seen, f"{self.report}/seen", known[-1] + 1 if known else 0)
        return changed + gone

    def _seen(self) -> DataFrame:
        known = v.versions(self.spark, f"{self.report}/seen")
        if not known:
            raise ValueError(f"no days are kept at {self.report}")
        return self.spark.read.schema(SEEN).parquet(v.version_path(f"{self.report}/seen", known[-1]))

    def _kept(self, name: str) -> DataFrame:
        """Rows of the parts that the latest version names, of the days for which it names them."""
        seen = self._seen()
        parts = [r["part"] for r in seen.select("part").distinct().collect()]
        if not parts:
            raise ValueError(f"no days are kept at {self.report}")
        root = f"{self.report}/{name}"
        rows = self.spark.read.option("basePath", root).parquet(*[f"{root}/part={p}" for p in parts])
        day, part = seen["created_date"], seen["part"]
        return rows.join(seen, rows["created_date"].eqNullSafe(day) & (rows["part"] == part), "left_semi").drop("part")

    def _sums(self) -> DataFrame:
        return self._kept("sums")

    def modality_stats(self) -> DataFrame:
        """As quality.modality_stats."""
        uris = self._kept("uris").groupBy("modality", "source").agg(F.countDistinct("uri").alias("unique_files"))
        sums = self._sums().groupBy("modality", "source").agg(
            F.sum("documents").alias("document_count"), (F.sum("chars") / F.sum("texts")).alias("avg_text_length"),
            F.max("latest").alias("latest_update"),
        )
        u = uris.select(F.col("modality").alias("m"), F.col("source").alias("s"), "unique_files")
        both = sums.join(u, F.col("modality").eqNullSafe(F.col("m")) & F.col("source").eqNullSafe(F.col("s")), "left")
        return both.select(
            "modality", "source", "document_count", F.coalesce("unique_files", F.lit(0)).alias("unique_files"),
            "avg_text_length", "latest_update",
        ).orderBy(F.col("document_count").desc(), "modality", "source")

    def document_stats(self) -> DataFrame:
        """As quality.document_stats."""
        return self._sums().groupingSets([["modality", "source"], []], "modality", "source").agg(
            F.sum("documents").alias("count"), F.max("latest").alias("latest")
        )

    def embedding_stats(self) -> DataFrame:
        """As quality.embedding_stats."""
        n = lambda c: F.coalesce(F.sum(c), F.lit(0))
        return self._sums().agg(
            n("texts").alias("total_documents"), n("texts_embedded").alias("documents_with_embeddings"),
            (n("texts") - n("texts_embedded")).alias("documents_without_embeddings"),
            (F.sum("dims") / F.sum("dims_n")).alias("avg_embedding_dimension"),
        ).withColumn("coverage_percentage", _share(F.col("documents_with_embeddings"), F.col("total_documents")))

    def corpus_totals(self) -> DataFrame:
        """As quality.corpus_totals."""
        n = lambda c: F.coalesce(F.sum(c), F.lit(0))
        return self._sums().agg(
            n("documents").alias("total_docs"), n("embedded").alias("total_embedded"), n("texts").alias("total_searchable")
        )
