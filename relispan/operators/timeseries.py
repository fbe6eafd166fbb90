"""Time series: scaling, matrix profiles, k-of-N profiles, discords, windows around events.

A series table has (series_id, i, v): ``i`` counts the samples of a series from 0. Profiles have (series_id, i, p, nn):
``p`` is the distance of the subsequence that begins at ``i`` to its nearest neighbour, which begins at ``nn``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relispan.plans.shared import shared_table

TILE = 2048  # subsequences to a side of a tile: a tile's distances take 32 MB


def regular_series(rows: DataFrame, series: str, time: str, value: str, unit: str = "hour") -> DataFrame:
    """(series_id, t, i, v): means by unit of time; ``i`` numbers the units that hold rows."""
    means = rows.groupBy(F.col(series).alias("series_id"), F.date_trunc(unit, F.col(time)).alias("t")).agg(F.avg(value).alias("v"))
    order = Window.partitionBy("series_id").orderBy("t")
    return means.withColumn("i", (F.row_number().over(order) - 1).cast("bigint")).select("series_id", "t", "i", "v")


def fit_scale(series: DataFrame, norm: str | None = "robust") -> DataFrame:
    """(series_id, center, spread) of each series: median and interquartile range, or mean and population deviation.

    Any name but ``robust`` and None is refused. A spread of 0 counts as 1.
    """
    if norm == "robust":
        q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        found = series.groupBy("series_id").agg(q.alias("q")).select("series_id", F.col("q")[1].alias("center"), (F.col("q")[2] - F.col("q")[0]).alias("spread"))
    elif norm is None:
        found = series.groupBy("series_id").agg(F.avg("v").alias("center"), F.stddev_pop("v").alias("spread"))
    else:
        raise ValueError(f"unknown scaling {norm!r}")
    return found.withColumn("spread", F.when(F.col("spread") == 0, 1.0).otherwise(F.col("spread")))


def apply_scale(series: DataFrame, scale: DataFrame) -> DataFrame:
    """The series with ``v`` scaled by parameters fitted before, perhaps on other rows."""
    return series.join(scale, "series_id").withColumn("v", (F.col("v") - F.col("center")) / F.col("spread")).drop("center", "spread")


def _tiles(series: DataFrame, m: int, role: str, tile: int) -> DataFrame:
    """Blocks of subsequences: (series_id, block, role, first, values); a block also holds the m - 1 samples behind it."""
    block = F.floor(F.col("i") / tile)
    reach = F.when((F.col("i") % tile < m - 1) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    rows = series.select("series_id", "i", "v", F.explode(reach).alias("block"))
    packed = rows.groupBy("series_id", "block").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("s"))
    return packed.select("series_id", "block", F.lit(role).alias("role"), F.expr("transform(s, x -> x.v)").alias("values")).filter(F.size("values") >= m)


def _windows(values, m: int, znorm: bool) -> np.ndarray:
    w = np.lib.stride_tricks.sliding_window_view(np.asarray(values, np.float64), m)
    if znorm:
        sd = w.std(1, keepdims=True)
        w = (w - w.mean(1, keepdims=True)) / np.where(sd == 0, 1, sd)
    return w


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances; small ones are taken anew from differences, for products lose their digits."""
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    scale = max(1e-300, float((a * a).sum(1).max(initial=0) + (b * b).sum(1).max(initial=0)))
    i, j = np.nonzero(d2 < 1e-6 * scale)
    for low in range(0, len(i), 1 << 16):
        x, y = i[low : low + (1 << 16)], j[low : low + (1 << 16)]
        d2[x, y] = ((a[x] - b[y]) ** 2).sum(1)
    return np.sqrt(np.maximum(d2, 0))


def matrix_profile(series: DataFrame, m: int, other: DataFrame | None = None, znorm: bool = False, zone_denominator: int = 4, share: float = 1.0, tile: int = TILE) -> DataFrame:
    """(series_id, i, p, nn, left_p, left_nn, right_p, right_nn) of each subsequence of m samples.

    Without ``other`` the neighbours are of the same series and more than ceil(m / zone_denominator) samples away; with
    it (an annotated series of the same series_id) they are its subsequences, and there is no left and right. Distances
    are Euclidean, of z-normalised subsequences on demand; of equal distances the smallest nn counts. ``share`` below 1
    looks at so much of the pairs of blocks, chosen by a hash, and always at a block's own pair; 1 is exact.

    Each pair of blocks is a task of its own, so that one long series spreads over the cluster.
    """
    zone = math.ceil(m / zone_denominator)
    left = shared_table(_tiles(series, m, "a", tile), "tiles")  # read several times; what it is made from is read once
    right = left.withColumn("role", F.lit("b")) if other is None else shared_table(_tiles(other, m, "b", tile), "tiles")
    counts = right.groupBy("series_id").agg(F.max("block").alias("last_b"))
    lasts = left.groupBy("series_id").agg(F.max("block").alias("last_a"))
    a = left.join(counts, "series_id").select("series_id", "role", "values", F.col("block").alias("ab"), F.explode(F.sequence(F.lit(0), F.col("last_b"))).alias("bb"))
    b = right.join(lasts, "series_id").select("series_id", "role", "values", F.explode(F.sequence(F.lit(0), F.col("last_a"))).alias("ab"), F.col("block").alias("bb"))
    pairs = a.unionByName(b)
    if share < 1:
        chosen = F.pmod(F.xxhash64("series_id", "ab", "bb"), F.lit(1_000_000)) < int(share * 1_000_000)
        pairs = pairs.filter(chosen | (F.col("ab") == F.col("bb")))
    own = other is None

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names = ["series_id", "i", "p", "nn", "left_p", "left_nn", "right_p", "right_nn"]
        parts = {r: v for r, v in zip(rows["role"], rows["values"], strict=True)}
        if len(parts) < 2:
            return pd.DataFrame(columns=names)
        x, y = _windows(parts["a"], m, znorm), _windows(parts["b"], m, znorm)
        x, y = x[:tile], y[:tile]
        i, j = key[1] * tile + np.arange(len(x)), key[2] * tile + np.arange(len(y))
        d = _distances(x, y)
        out = {"series_id": key[0], "i": i}
        gap = j[None, :] - i[:, None]
        masks = {"": np.abs(gap) > zone if own else np.ones_like(d, bool)}
        if own:
            masks |= {"left_": gap < -zone, "right_": gap > zone}
        for name in ("", "left_", "right_"):
            e = np.where(masks[name], d, np.inf) if name in masks else np.full_like(d, np.inf)
            best = e.argmin(1) if e.shape[1] else np.zeros(len(i), int)
            p = e[np.arange(len(i)), best] if e.shape[1] else np.full(len(i), np.inf)
            out[name + "p"] = p
            out[name + "nn"] = pd.array(np.where(np.isfinite(p), j[best] if len(j) else 0, -1), "Int64")
        made = pd.DataFrame(out)
        for name in ("p", "left_p", "right_p"):
            made[name] = made[name].where(np.isfinite(made[name]), None)
        return made[names]

    schema = "series_id string, i bigint, p double, nn bigint, left_p double, left_nn bigint, right_p double, right_nn bigint"
    each = pairs.groupBy("series_id", "ab", "bb").applyInPandas(run, schema)
    least = lambda s: F.min(F.when(F.col(f"{s}p").isNotNull(), F.struct(f"{s}p", f"{s}nn"))).alias(f"{s}best")
    best = each.groupBy("series_id", "i").agg(least(""), least("left_"), least("right_"))
    return best.select(
        "series_id",
        "i",
        *[F.col(f"{s}best.{s}{c}").alias(f"{s}{c}") for s in ("", "left_", "right_") for c in ("p", "nn")],
    )


def k_of_n(profile: DataFrame) -> DataFrame:
    """(i, k, dp, series_id): at each i the series' distances in falling order; ties by series_id."""
    order = Window.partitionBy("i").orderBy(F.desc("p"), "series_id")
    return profile.select("i", F.row_number().over(order).alias("k"), F.col("p").alias("dp"), "series_id")


def discords(profile: DataFrame, k: int) -> DataFrame:
    """(series_id, rank, i, p): each series' k subsequences that are farthest from their neighbours; ties by i."""
    order = Window.partitionBy("series_id").orderBy(F.desc("p"), "i")
    return profile.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("series_id", "rank", "i", "p")


def anomaly_intervals(profile: DataFrame, m: int, threshold: Column) -> DataFrame:
    """(series_id, first, last, n, peak): runs of overlapping subsequences whose distance is over the threshold."""
    order = Window.partitionBy("series_id").orderBy("i")
    high = profile.filter(F.col("p") > threshold)
    new = (F.col("i") - F.coalesce(F.lag("i").over(order), F.lit(-m - 1)) >= m).cast("int")
    runs = high.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    return runs.groupBy("series_id", "run").agg(
        F.min("i").alias("first"), (F.max("i") + m - 1).alias("last"), F.count("*").alias("n"), F.max("p").alias("peak")
    ).drop("run")


def event_windows(series: DataFrame, events: DataFrame, w: int) -> DataFrame:
    """(event_id, series_id, side, i, v): the w samples before an event's place (front) and from it on (rear).

    The places join by blocks of w samples, so that each event meets two or three blocks and no other rows.
    """
    loc = events.select("event_id", "series_id", F.col("loc").cast("bigint").alias("loc"))
    near = loc.withColumn("block", F.explode(F.sequence(F.floor((F.col("loc") - w) / w), F.floor((F.col("loc") + w - 1) / w))))
    rows = series.withColumn("block", F.floor(F.col("i") / w))
    inside = (F.col("i") >= F.col("loc") - w) & (F.col("i") < F.col("loc") + w)
    side = F.when(F.col("i") < F.col("loc"), "front").otherwise("rear")
    return near.join(rows, ["series_id", "block"]).filter(inside).select("event_id", "series_id", side.alias("side"), "i", "v")


def random_windows(series: DataFrame, w: int, n: int, seed: int = 0) -> DataFrame:
    """(series_id, k, i, v): n windows of w samples of each series, from seeded random starts below its last window.

    Starts may repeat. The windows meet the samples by blocks, as around events.
    """
    size = series.groupBy("series_id").agg(F.max("i").alias("last"))
    start = F.pmod(F.xxhash64("series_id", "k", F.lit(seed)), F.greatest(F.lit(1), F.col("last") + 1 - w))
    wanted = size.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n)))).select("series_id", "k", start.alias("start"))
    near = wanted.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / w), F.floor((F.col("start") + w - 1) / w))))
    met = near.join(series.withColumn("block", F.floor(F.col("i") / w)), ["series_id", "block"])
    return met.filter((F.col("i") >= F.col("start")) & (F.col("i") < F.col("start") + w)).select("series_id", "k", "i", "v")


def t_scores(windows: DataFrame) -> DataFrame:
    """(event_id, series_id, n, t): front mean less rear mean over the root of the sum of variances by n.

    Null where the sides differ in size or do not vary.
    """
    s = windows.groupBy("event_id", "series_id").pivot("side", ["front", "rear"]).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
    noise = (F.col("front_var") + F.col("rear_var")) / F.col("front_n")
    t = (F.col("front_mean") - F.col("rear_mean")) / F.sqrt(noise)
    return s.select("event_id", "series_id", F.col("front_n").alias("n"), F.when((F.col("front_n") == F.col("rear_n")) & (noise > 0), t).alias("t"))


def thin(series: DataFrame, step: int) -> DataFrame:
    """Every step-th sample of each series, from the first."""
    return series.filter(F.col("i") % step == 0)


def resample(series: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(series_id, i, v): ``n`` samples of each series drawn with replacement, at places by a seeded hash."""
    size = series.groupBy("series_id").agg(F.max("i").alias("last"))
    drawn = size.select("series_id", "last", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("k"))
    drawn = drawn.select("series_id", F.col("k"), F.pmod(F.xxhash64("series_id", "k", F.lit(seed)), F.col("last") + 1).alias("i"))
    return drawn.join(series.select("series_id", "i", "v"), ["series_id", "i"]).select("series_id", F.col("k").alias("i"), "v")
