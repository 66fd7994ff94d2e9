"""Updates of a table kept by day that rewrite the days they change and no others.

    <table>/created_date=<day>/            what write_table wrote
    <table>/_parts/part=<name>/created_date=<day>/   what updates and appends wrote since
    <table>/_days/v=<number>/              for each day the folders that hold it

A table without versions is what stands in its folders. An update finds the days that hold a touched row from keys alone,
writes those days anew as one part, and then one version that names it. Files are never changed or deleted, so a reader
keeps the state it opened; `vacuum` deletes what the latest version does not name. Overwriting day folders in place would
take files from readers and show some days old and some new.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semcorpus.sources import versions as v
from semcorpus.sources.tables import declared

DAYS = "created_date date, folders array<string>"
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def _name(day: date | None) -> str:
    return f"created_date={NO_DAY if day is None else day.isoformat()}"


def _day(folder: str) -> date | None:
    value = folder.rpartition("created_date=")[2]
    return None if value == NO_DAY else date.fromisoformat(value)


def state(spark: SparkSession, path: str) -> tuple[int, dict[date | None, list[str]]]:
    """The latest version (-1: none yet), and the folders of each day relative to the table. One entry per day."""
    known = v.versions(spark, f"{path}/_days")
    if known:
        rows = spark.read.schema(DAYS).parquet(v.version_path(f"{path}/_days", known[-1])).collect()
        return known[-1], {r["created_date"]: list(r["folders"]) for r in rows}
    found = [f for f in v.folders(spark, path) if "created_date=" in f]
    return -1, {_day(f): [_name(_day(f))] for f in found}


def _schema(spark: SparkSession, path: str, schema: T.StructType | None) -> T.StructType | None:
    schema = schema or declared(spark, path)
    return schema and T.StructType([*[f for f in schema.fields if f.name != "created_date"], T.StructField("created_date", T.DateType())])


def read_days(
    spark: SparkSession, path: str, days: list | None = None, schema: T.StructType | None = None, at: dict | None = None
) -> DataFrame:
    """The table as its latest version (or the state `at`) has it; with days, from the folders of those days alone."""
    held = state(spark, path)[1] if at is None else at
    found = [f for day, fs in held.items() if days is None or day in days for f in fs]
    own = [f"{path}/{f}" for f in found if not f.startswith("_parts/")]
    parts = [f"{path}/{f}" for f in found if f.startswith("_parts/")]
    full = _schema(spark, path, schema)
    reader = spark.read if full is None else spark.read.schema(full)

    def dated(rows: DataFrame) -> DataFrame:
        # Where all rows have no day, Spark finds no type for it.
        return rows if rows.schema["created_date"].dataType == T.DateType() else rows.withColumn("created_date", F.col("created_date").cast("date"))

    out = None
    if parts:
        typed = spark.read if full is None else spark.read.schema(T.StructType([*full.fields, T.StructField("part", T.StringType())]))
        out = dated(typed.option("basePath", f"{path}/_parts").parquet(*parts).drop("part"))
    if own:
        rows = dated(reader.option("basePath", path).parquet(*own))
        out = rows if out is None else rows.unionByName(out)
    if out is None:
        if full is None:
            raise ValueError(f"no rows at {path}, and no schema is declared")
        return spark.createDataFrame([], full)
    return out


def _write_part(rows: DataFrame, path: str, part: str) -> list[date | None]:
    """Write rows by day as one part; whatever an earlier try left of it is replaced. Returns the days."""
    (
        rows.hint("rebalance", "created_date").write.mode("overwrite").partitionBy("created_date")
        .parquet(f"{path}/_parts/part={part}")
    )
    return [_day(f) for f in v.folders(rows.sparkSession, f"{path}/_parts/part={part}")]


def _publish(spark: SparkSession, path: str, version: int, held: dict) -> int:
    rows = [(day, fs) for day, fs in held.items()]
    v.commit(spark.createDataFrame(rows, DAYS), f"{path}/_days", version)
    return version


def update_days(
    spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], touched: DataFrame | Column,
    key: str = "doc_id", schema: T.StructType | None = None,
) -> list[date | None]:
    """Rewrite the days that hold touched rows; returns them.

    touched is a table of keys or a condition on rows. `change` maps the rows of those days to their new rows (with
    created_date); rows it does not touch must come back as they are. Finding the days reads the key column (or those of
    the condition) and nothing else. The days of a table are few enough for the driver.
    """
    version, held = state(spark, path)
    rows = read_days(spark, path, schema=schema, at=held)
    if isinstance(touched, DataFrame):
        wanted = touched.select(F.col(key).alias("__key")).where("__key IS NOT NULL")
        hit = rows.select(key, "created_date").join(wanted, F.col(key) == F.col("__key"), "left_semi")
    else:
        hit = rows.where(touched)
    days = [r["created_date"] for r in hit.select("created_date").distinct().collect()]
    if not days:
        return []
    part = uuid.uuid4().hex
    fresh = set(_write_part(change(read_days(spark, path, days, schema, held)), path, f"u{part}"))
    if not fresh <= set(days):
        raise ValueError("an update may not move rows to other days")
    now = {day: fs for day, fs in held.items() if day not in days}
    _publish(spark, path, version + 1, now | {day: [f"_parts/part=u{part}/{_name(day)}"] for day in days if day in fresh})
    return days


def append_days(rows: DataFrame, path: str, part: str | None = None) -> bool:
    """Add rows (with created_at) to a table as one part. A part that the table has already is not added again, so a named
    part can be written twice without harm; returns whether it was added."""
    spark = rows.sparkSession
    part = f"a{part or uuid.uuid4().hex}"
    version, held = state(spark, path)
    if any(f.startswith(f"_parts/part={part}/") for fs in held.values() for f in fs):
        return False
    days = _write_part(rows.withColumn("created_date", F.to_date("created_at")), path, part)
    if not days:
        return False
    _publish(spark, path, version + 1, held | {d: [*held.get(d, []), f"_parts/part={part}/{_name(d)}"] for d in days})
    return True


def replace_days(rows: DataFrame, path: str, days: list[date | None]) -> None:
    """Put rows (with created_date) in the place of all rows of some days; a day without rows ends."""
    spark = rows.sparkSession
    version, held = state(spark, path)
    part = f"r{uuid.uuid4().hex}"
    fresh = _write_part(rows, path, part)
    if not set(fresh) <= set(days):
        raise ValueError("rows of other days")
    _publish(spark, path, version + 1, {d: fs for d, fs in held.items() if d not in days} | {d: [f"_parts/part={part}/{_name(d)}"] for d in fresh})


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete folders that the latest version does not name, and older versions. No reader may be on an older state."""
    version, held = state(spark, path)
    if version < 0:
        return 0
    named = {f for fs in held.values() for f in fs}
    gone = 0
    for folder in v.folders(spark, path):
        if "created_date=" in folder and _name(_day(folder)) not in named:
            gone += v.delete(spark, folder)
    for part in v.folders(spark, f"{path}/_parts"):
        name = f"_parts/part={part.rpartition('part=')[2]}"
        for folder in v.folders(spark, part):
            if f"{name}/{_name(_day(folder))}" not in named:
                gone += v.delete(spark, folder)
    for old in v.versions(spark, f"{path}/_days")[:-1]:
        gone += v.delete(spark, v.version_path(f"{path}/_days", old))
    return gone
