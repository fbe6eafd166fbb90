"""The matrix profile of growing series, sample by sample."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

OUT = "series_id string, i bigint, p double, nn bigint"
STATE = "first bigint, v binary, p binary, nn binary"


def extend(values: np.ndarray, p: np.ndarray, nn: np.ndarray, new: np.ndarray, m: int, zone: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values, distances and neighbours after more samples, and the places whose entries are new or changed.

    Each new subsequence meets all earlier ones beyond the exclusion zone; both ends take the nearer neighbour.
    """
    v = np.concatenate([values, new])
    n = max(0, len(v) - m + 1)
    old = len(p)
    p, nn = np.concatenate([p, np.full(n - old, np.inf)]), np.concatenate([nn, np.full(n - old, -1, np.int64)])
    changed = np.zeros(n, bool)
    changed[old:] = True
    if n == 0:
        return v, p, nn, np.flatnonzero(changed)
    w = np.lib.stride_tricks.sliding_window_view(v, m)
    for k in range(old, n):
        far = k - zone  # earlier ones begin before this
        if far <= 0:
            continue
        d = np.sqrt(((w[:far] - w[k]) ** 2).sum(1))
        j = int(d.argmin())
        if d[j] < p[k]:
            p[k], nn[k] = d[j], j
        nearer = np.flatnonzero(d < p[:far])
        p[nearer], nn[nearer] = d[nearer], k
        changed[nearer] = True
    return v, p, nn, np.flatnonzero(changed)


def incremental_profile(stream: DataFrame, m: int, zone_denominator: int = 4, out_mode: str = "update") -> DataFrame:
    """(series_id, i, p, nn) of each subsequence that a batch adds or brings nearer, from a stream (series_id, i, v).

    ``i`` counts samples without gaps, and a series' samples come in order. The history is kept whole, as every later
    subsequence may be nearest to any earlier one, so that a series' state grows with it. Subsequences without a
    neighbour as yet have p and nn null.
    """
    zone = math.ceil(m / zone_denominator)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("i")
        if state.exists:
            first, *kept = state.get
            v, p, nn = (np.frombuffer(bytes(x), t) for x, t in zip(kept, (np.float64, np.float64, np.int64), strict=True))
        else:
            first, v, p, nn = int(rows["i"].iloc[0]), np.zeros(0), np.zeros(0), np.zeros(0, np.int64)
        if rows["i"].to_list() != list(range(first + len(v), first + len(v) + len(rows))):
            raise ValueError(f"samples of series {key[0]} are missing or out of order")
        v, p, nn, at = extend(v, p, nn, rows["v"].to_numpy(np.float64), m, zone)
        state.update((first, v.tobytes(), p.tobytes(), nn.tobytes()))
        found = nn[at] >= 0
        yield pd.DataFrame(
            {
                "series_id": [key[0]] * len(at),
                "i": at + first,
                "p": np.where(found, p[at], np.nan),  # which Arrow takes for null
                "nn": pd.Series(nn[at] + first, dtype="Int64").mask(~found),
            }
        )

    return stream.groupBy("series_id").applyInPandasWithState(run, OUT, STATE, out_mode, "NoTimeout")
