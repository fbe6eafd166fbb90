"""Bitmaps of fixed size that go to all tasks, so that rows which surely have no partner take no part in a join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 25  # 4 MB, whatever the number of rows


def bitmap(hashes: DataFrame, bits: int = BITS) -> np.ndarray:
    """The places (the low bits) of the hashes ``h``, eight to a byte; never more than ``bits`` / 8 bytes."""
    part = min(bits, 1 << 15)
    place = F.pmod(F.col("h"), F.lit(bits))
    parts = hashes.groupBy(F.floor(place / part).alias("part")).agg(F.bitmap_construct_agg((place % part).cast("bigint")).alias("bytes"))
    out = np.zeros((bits // part, 4096), np.uint8)
    for r in parts.collect():  # 4096 bytes each
        out[r["part"]] = np.frombuffer(bytes(r["bytes"]), np.uint8)
    return out[:, : part // 8].ravel()


def known(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Whether unsigned 64-bit hashes may be among those of a bitmap; False is certain."""
    place = values & np.uint64(8 * len(held) - 1)
    return (held[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def maybe(hashed: Column, hashes: DataFrame, bits: int = BITS) -> Column:
    """Whether a hash (long, not null) may be among ``hashes`` (h); False is certain."""
    held = hashes.sparkSession.sparkContext.broadcast(bitmap(hashes, bits))

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(known(s.to_numpy(np.int64).view(np.uint64), held.value))

    return run(hashed)
