"""Parquet tables: create, load, append, copy, export and check."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semcorpus.functions.text import head
from semcorpus.session import shared_dir
from semcorpus.sources.schemas import CORE_TABLES, SIDE_TABLES, conform
from semcorpus.sources.versions import versions


def write_table(
    df: DataFrame, path: str, mode: str = "append", sort_by: Sequence[str] = ("modality", "source")
) -> None:
    """Write with one folder per day of created_at, each file sorted by sort_by.

    The rebalance hint lets AQE gather a day's rows into few files and split a day that is too large.
    Never write over a path the same plan reads: write a new folder and point readers at it.
    """
    if mode == "append" and versions(df.sparkSession, f"{path}/_days"):
        raise ValueError("the table has versions; use append_days")
    dated = df.withColumn("created_date", F.to_date("created_at"))
    (
        dated.hint("rebalance", "created_date")
        .sortWithinPartitions("created_date", *sort_by)
        .write.mode(mode)
        .partitionBy("created_date")
        .parquet(path)
    )


def _schema_path(spark: SparkSession, path: str):
    """A file that readers of the table pass over."""
    file = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_declared_schema.json")
    return file.getFileSystem(spark._jsc.hadoopConfiguration()), file


def declare(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Keep the declared schema beside the rows, as a table without rows keeps none."""
    fs, file = _schema_path(spark, path)
    out = fs.create(file, True)
    out.write(bytearray(schema.json().encode()))
    out.close()


def declared(spark: SparkSession, path: str) -> T.StructType | None:
    fs, file = _schema_path(spark, path)
    if not fs.exists(file):
        return None
    data = fs.open(file)
    text = bytes(data.readAllBytes()).decode()
    data.close()
    return T.StructType.fromJson(json.loads(text))


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a table; created_date stays, as the column to prune days by. Created tables know their own schema.

    A table with versions is read as its latest one has it.
    """
    if versions(spark, f"{path}/_days"):
        from semcorpus.sources.updates import read_days

        return read_days(spark, path, schema=schema)
    schema = schema or declared(spark, path)
    if schema is None:
        return spark.read.parquet(path)
    dated = T.StructType([*schema.fields, T.StructField("created_date", T.DateType())])
    return spark.read.schema(dated).parquet(path)


def on_days(df: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """Add the day predicates that let the scan skip folders."""
    if "created_date" not in df.columns:
        return df
    if start is not None:
        df = df.where(F.col("created_date") >= F.lit(start.date()))
    if end is not None:
        df = df.where(F.col("created_date") <= F.lit(end.date()))
    return df


def create_tables(spark: SparkSession, root: str, side: bool = False) -> list[str]:
    """Empty core tables (and side tables) with their declared schema."""
    return _created(spark, root, {**CORE_TABLES, **(SIDE_TABLES if side else {})})


def create_side_tables(spark: SparkSession, root: str) -> list[str]:
    return _created(spark, root, SIDE_TABLES)


def _created(spark: SparkSession, root: str, tables: dict) -> list[str]:
    for name, (schema, sort_by) in tables.items():
        write_table(spark.createDataFrame([], schema), f"{root}/{name}", "overwrite", sort_by)
        declare(spark, f"{root}/{name}", schema)
    return sorted(tables)


def load_json_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Newline-delimited JSON under a declared schema; unknown fields are ignored."""
    return spark.read.schema(schema).json(path)


def append_rows(
    spark: SparkSession, rows: Iterable[dict], schema: T.StructType, path: str, sort_by: Sequence[str]
) -> int:
    """Append rows a caller holds in memory."""
    ordered = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
    write_table(spark.createDataFrame(ordered, schema), path, "append", sort_by)
    return len(ordered)


def copy_dataset(spark: SparkSession, src: str, dst: str, mode: str = "overwrite") -> None:
    if src.rstrip("/") == dst.rstrip("/"):
        raise ValueError("source and destination are the same folder")
    df = spark.read.parquet(src)
    parts = ["created_date"] if "created_date" in df.columns else []
    df.write.mode(mode).partitionBy(*parts).parquet(dst)


# Results of at most so many rows are numbered and written by one task.
EXPORT_ROWS = 100_000


def ranked(results: DataFrame, order: Sequence, by: str = "rank") -> DataFrame:
    """Number rows 1..n in one task: for results that a limit has made small. `numbered` does so at any size."""
    return results.withColumn(by, F.row_number().over(Window.orderBy(*order)))


def numbered(results: DataFrame, order: Sequence, by: str = "rank") -> DataFrame:
    """Number rows 1..n over many tasks, in ranges of the order: those of a task go on from where the task before ends.

    The sorted rows are written to the shared folder, as ranges are drawn anew each time they are computed.
    """
    spark, path = results.sparkSession, f"{shared_dir(results.sparkSession)}/numbered-{uuid.uuid4().hex}"
    rows = results.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumn("__at", F.monotonically_increasing_id())
    rows.write.parquet(path)
    held = spark.read.schema(rows.schema).parquet(path).withColumn("__part", F.shiftrightunsigned("__at", 33))
    # One row per task.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return held.join(F.broadcast(offsets), "__part").withColumn(by, F.col("__base") + inside + 1).select(*results.columns, by)


def export_frame(results: DataFrame, text_chars: int = 500, few: bool = True) -> DataFrame:
    """Rank, keys, score and the start of the text, in distance order."""
    order = [F.col("distance"), F.col("doc_id")]
    return (ranked if few else numbered)(results, order).select(
        "rank", "doc_id", "uri", "source", "modality",
        F.coalesce(F.col("rel_score"), F.col("distance")).alias("score"),
        head("text_content", text_chars).alias("text_content"),
    )


def export_results(results: DataFrame, path: str, fmt: str = "csv", one_file: int = EXPORT_ROWS) -> None:
    """Write search results as CSV with a header or as JSON lines, in order.

    Up to `one_file` rows make one file; more make one file per task, and the files follow the order by name.
    """
    if fmt not in ("csv", "json"):
        raise ValueError(f"unknown export format {fmt!r}")
    few = results.limit(one_file + 1).count() <= one_file
    if fmt == "csv":
        rows, order = export_frame(results, few=few), ["rank"]
    else:
        rows, order = results, ["distance", "doc_id"]
    writer = (rows.orderBy(*order).coalesce(1) if few else rows.orderBy(*order)).write.mode("overwrite")
    if fmt == "csv":
        writer.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    else:
        writer.json(path)


def check_contract(df: DataFrame, schema: T.StructType) -> DataFrame:
    """One row per declared column: is it present with its type, is it required, how many NULLs."""
    have = {f.name: f.dataType for f in df.schema.fields}
    present = [f.name for f in schema.fields if f.name in have]
    counts = df.agg(
        *[F.count_if(F.col(n).isNull()).alias(n) for n in present], F.count(F.lit(1)).alias("__rows")
    )
    # One stack call turns the single row of counts into one row per column.
    entries = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.name in have).alias("present"),
            F.lit(f.name in have and have[f.name].simpleString() == f.dataType.simpleString()).alias("type_ok"),
            F.lit(not f.nullable).alias("required"),
            (F.col(f.name) if f.name in have else F.col("__rows")).alias("null_rows"),
        )
        for f in schema.fields
    ]
    return (
        counts.select(F.inline(F.array(*entries)))
        .withColumn("ok", F.col("present") & F.col("type_ok") & (~F.col("required") | (F.col("null_rows") == 0)))
    )


def missing_tables(spark: SparkSession, root: str, names: Sequence[str] = tuple(CORE_TABLES)) -> list[str]:
    """Declared tables that have no folder under root."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    gone = []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        if not path.getFileSystem(conf).exists(path):
            gone.append(name)
    return gone
