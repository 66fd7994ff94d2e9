"""Leaving out what is known already without shuffling what is known."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of a filter; its size does not depend on the rows. With more keys than an eighth of it, it rules out less.
FILTER_BITS = 24


def key_filter(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter of two places per key as 64-bit words. Tasks combine their bits; the driver gets one row per word."""
    h = F.xxhash64(key)
    places = F.explode(F.array(*[F.pmod(F.shiftrightunsigned(h, s), F.lit(1 << bits)) for s in (0, bits)])).alias("place")
    words = keys.where(F.col(key).isNotNull()).select(places).select(
        F.shiftright("place", 6).alias("at"), F.expr("shiftleft(1L, CAST(place & 63 AS INT))").alias("bit")
    )
    held = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(max(1 << bits >> 6, 1), np.uint64)
    out[held.column(0).to_numpy().astype(np.int64)] = held.column(1).to_numpy().view(np.uint64)
    return out


def may_hold(words: np.ndarray, key: str) -> Column:
    """Whether a key may be among those of a filter; false is certain."""
    bits = int(np.log2(len(words))) + 6

    @F.arrow_udf("boolean")
    def held(hashes: pa.Array) -> pa.Array:
        h = hashes.to_numpy(zero_copy_only=False).view(np.uint64)
        found = np.ones(len(h), bool)
        for s in (0, bits):
            place = h >> np.uint64(s) & np.uint64((1 << bits) - 1)
            found &= (words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return pa.array(found)

    return held(F.xxhash64(key))


def drop_known(fresh: DataFrame, known: DataFrame, key: str = "uri", bits: int = FILTER_BITS) -> DataFrame:
    """Rows whose key is not among the known; a NULL key is never known.

    A filter of the fresh keys is made first and sent to the known side, so that only known rows that may be among the fresh
    ones are shuffled for the exact join. Reads the fresh keys once when called.
    """
    words = key_filter(fresh.select(key), key, bits)
    suspects = known.select(key).where(F.col(key).isNotNull()).where(may_hold(words, key))
    return fresh.join(suspects, key, "left_anti").select(fresh.columns)
