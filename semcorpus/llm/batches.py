"""Helpers for kernels that work on Arrow batches with numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20
# Rows that travel between Spark and Python at a time. Texts are long, so the default of 10,000 would hold much memory
# on both sides.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let Arrow batches be small in this session; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins and the last ends. Null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    return raw, ends - ends[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes of text each; a longer text is a range of its own."""
    if len(texts) == 0:
        return
    _, ends = utf8(texts)
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(ends, ends[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        yield lo, hi
        lo = hi


def few_rows(batch: pa.RecordBatch, rows: int = 128) -> Iterator[pa.RecordBatch]:
    """The batch a few rows at a time, for work on Python objects that take far more memory than Arrow."""
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """`values` cut into one list per row."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), values)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or a longer one if the table has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release() -> None:
    """Give back to the system what this process has freed: Spark keeps its Python workers, and several idle ones add up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def extend(df: DataFrame, text_col: str, fields: list[tuple[str, T.DataType]], kernel: Callable, limit: int = SLICE_BYTES) -> DataFrame:
    """Every row with further columns. `kernel(texts)` returns one array for each of `fields` in their order.

    `fields` names must be free in `df` (`free_name`). One pass over the rows without a shuffle, about `limit` bytes of text
    at a time.
    """
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t, True) for n, t in fields]])
    place = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            names = [*batch.schema.names, *[n for n, _ in fields]]
            for lo, hi in slices(batch.column(place), limit):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, *kernel(part.column(place))], names=names)
        release()

    return df.mapInArrow(run, schema)


def shared(spark, value) -> Broadcast:
    """A value of bounded size for all tasks; the caller states the bound."""
    return spark.sparkContext.broadcast(value)


def fold(key: Column, folds: int) -> Column:
    """Which of `folds` parts a row belongs to, by the CRC-32 of its key as text; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % folds
