"""Many small groups through Python without a call per group on the JVM side."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _group_starts(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Rows of a batch at which the keys differ from the row before; row 0 always counts."""
    new = np.zeros(batch.num_rows, dtype=bool)
    new[0] = True
    for key in keys:
        codes = batch.column(key).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _last_key(batch: pa.RecordBatch, keys: Sequence[str], row: int) -> tuple:
    return tuple(batch.column(k)[row].as_py() for k in keys)


def map_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[pa.Table], pa.Table],
    schema: str | T.StructType,
) -> DataFrame:
    """Apply fn to the rows of every key, in order.

    Rows are shuffled by key and sorted, and a task cuts its Arrow batches where the key changes. It holds
    one group at a time, so keys must be fine enough for a group to fit into a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _group_starts(batch, keys)
            bounds = [*starts.tolist(), batch.num_rows]
            done = []
            for i in range(len(starts)):
                if i or key != _last_key(batch, keys, 0):
                    if held:
                        done.append(fn(pa.Table.from_batches(held)))
                    held = []
                held.append(batch.slice(bounds[i], bounds[i + 1] - bounds[i]))
            key = _last_key(batch, keys, batch.num_rows - 1)
            if done:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
        if held:
            yield from fn(pa.Table.from_batches(held)).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
