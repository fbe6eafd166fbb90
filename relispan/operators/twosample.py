"""Kernel two-sample tests, and how an event relates to a series."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 1024


def _squares(a, b):
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def _chi2(a, b):
    top = (a[:, None, :] - b[None, :, :]) ** 2
    low = a[:, None, :] + b[None, :, :]
    return -np.where(low == 0, 0, top / np.where(low == 0, 1, low)).sum(2)


#: Kernels by name: functions of two sets of rows, gamma, degree and the constant term.
KERNELS = {
    "linear": lambda a, b, g, d, c: a @ b.T,
    "poly": lambda a, b, g, d, c: (g * (a @ b.T) + c) ** d,
    "rbf": lambda a, b, g, d, c: np.exp(-g * _squares(a, b)),
    "laplacian": lambda a, b, g, d, c: np.exp(-g * np.abs(a[:, None, :] - b[None, :, :]).sum(2)),
    "sigmoid": lambda a, b, g, d, c: np.tanh(g * (a @ b.T) + c),
    "cosine": lambda a, b, g, d, c: (a @ b.T) / np.maximum(np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :], 1e-300),
    "additive_chi2": lambda a, b, g, d, c: _chi2(a, b),
    "chi2": lambda a, b, g, d, c: np.exp(g * _chi2(a, b)),
}


def kernel(name: str, a, b, gamma: float = 1.0, degree: int = 3, constant: float = 1.0) -> np.ndarray:
    """Kernel values of all pairs of rows."""
    if name not in KERNELS:
        raise ValueError(f"unknown kernel {name!r}")
    return KERNELS[name](np.asarray(a, float), np.asarray(b, float), gamma, degree, constant)


def kernel_sums(rows: DataFrame, name: str = "rbf", gamma: float = 1.0, degree: int = 3, constant: float = 1.0, tile: int = TILE) -> DataFrame:
    """(side_a, side_b, total, trace, largest, pairs) of rows (id, side, x array): sums over all ordered pairs.

    Rows are dealt to blocks by a hash; each pair of blocks is a task, and only sums leave it.
    """
    n = max(1, math.ceil(rows.count() / tile))
    placed = rows.select("id", "side", "x", F.pmod(F.xxhash64("id"), F.lit(n)).alias("block"))
    a = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(F.col("block").alias("ab"), F.col("other").alias("bb"), F.lit(True).alias("first"), "id", "side", "x")
    b = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(F.col("other").alias("ab"), F.col("block").alias("bb"), F.lit(False).alias("first"), "id", "side", "x")

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        x, y = part[part["first"]], part[~part["first"]]
        for s, u in x.groupby("side"):
            for t, v in y.groupby("side"):
                k = kernel(name, np.stack(u["x"].to_list()), np.stack(v["x"].to_list()), gamma, degree, constant)
                same = u["id"].to_numpy()[:, None] == v["id"].to_numpy()[None, :] if s == t and key[0] == key[1] else None
                out.append((s, t, float(k.sum()), float(k[same].sum()) if same is not None else 0.0, float(k.max()), k.size))
        return pd.DataFrame(out, columns=["side_a", "side_b", "total", "trace", "largest", "pairs"])

    each = a.unionByName(b).groupBy("ab", "bb").applyInPandas(run, "side_a int, side_b int, total double, trace double, largest double, pairs bigint")
    return each.groupBy("side_a", "side_b").agg(F.sum("total").alias("total"), F.sum("trace").alias("trace"), F.max("largest").alias("largest"), F.sum("pairs").alias("pairs"))


def mmd(sums: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(m, n, mmd_u, mmd_b, ucb_u, ucb_b) from kernel_sums of sides 0 and 1; one row."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    pick = lambda a, b, c: F.max(F.when((F.col("side_a") == a) & (F.col("side_b") == b), F.col(c)))
    wide = sums.agg(
        F.sqrt(pick(0, 0, "pairs")).alias("m"),
        F.sqrt(pick(1, 1, "pairs")).alias("n"),
        *[pick(a, b, c).alias(f"{c}{a}{b}") for a, b in ((0, 0), (1, 1), (0, 1)) for c in ("total", "trace", "largest")],
    )
    m, n, log = F.col("m"), F.col("n"), math.log(1 / alpha)
    cross = 2 * F.col("total01") / (m * n)
    unbiased = (F.col("total00") - F.col("trace00")) / (m * (m - 1)) + (F.col("total11") - F.col("trace11")) / (n * (n - 1)) - cross
    biased = F.col("total00") / (m * m) + F.col("total11") / (n * n) - cross
    return wide.select(
        m.cast("bigint").alias("m"),
        n.cast("bigint").alias("n"),
        unbiased.alias("mmd_u"),
        biased.alias("mmd_b"),
        (4 * F.col("largest01") / F.sqrt(m) * math.sqrt(log)).alias("ucb_u"),
        (F.sqrt(2 * F.col("largest01") / m) * (1 + math.sqrt(2 * log))).alias("ucb_b"),
    )


def mmd_unbiased(k: np.ndarray, m: int) -> float:
    """Unbiased squared discrepancy from the kernel of pooled rows, the first m of one sample."""
    n = len(k) - m
    x, y, xy = k[:m, :m], k[m:, m:], k[:m, m:]
    return float((x.sum() - np.trace(x)) / (m * (m - 1)) + (y.sum() - np.trace(y)) / (n * (n - 1)) - 2 * xy.mean())


@lru_cache(maxsize=8)
def _permuted(n: int, m: int, iterations: int, seed: int) -> np.ndarray:
    """A row for each iteration: 1 for the m places of the first sample, 0 for others."""
    draw = np.random.RandomState(seed)
    out = np.zeros((iterations, n))
    for row in out:
        row[draw.permutation(n)[:m]] = 1
    return out


def permutation_test(x, y, name: str = "rbf", iterations: int = 200, seed: int = 0, thin: int = 1, **options) -> dict:
    """Statistic, p-value (no less than 1 / iterations), null distribution, bound and Chebyshev's decision of two samples."""
    x, y = np.atleast_2d(np.asarray(x, float).T).T[::thin], np.atleast_2d(np.asarray(y, float).T).T[::thin]
    k = kernel(name, np.vstack([x, y]), np.vstack([x, y]), **options)
    stat, m = mmd_unbiased(k, len(x)), len(x)
    a = _permuted(len(k), m, iterations, seed)  # all iterations in three products
    b, n = 1 - a, len(k) - m
    ka, trace = a @ k, np.diag(k)
    xx, yy, xy = (ka * a).sum(1) - a @ trace, ((b @ k) * b).sum(1) - b @ trace, (ka * b).sum(1)
    null = xx / (m * (m - 1)) + yy / (n * (n - 1)) - 2 * xy / (m * n)
    return {
        "statistic": stat,
        "p_value": max(1 / iterations, float((null > stat).mean())),
        "null": null,
        "ucb": 4 * float(k[:m, m:].max()) / math.sqrt(m) * math.sqrt(math.log(1 / 0.05)),
        "chebyshev_accepts": bool(abs(stat - null.mean()) < null.std() / math.sqrt(0.05)),
    }


def hash_permutations(rows: DataFrame, iterations: int, bucket_rows: int = 4096) -> DataFrame:
    """(iteration, id, side): the sides dealt anew ``iterations`` times, in the order of md5(iteration:id).

    Ranks are counted within buckets of the hash's first digits, and the buckets' sizes are summed, so that no task
    sorts a whole sample.
    """
    digits = max(0, math.ceil(math.log(max(1, rows.count()) / bucket_rows, 16)))
    hashed = F.md5(F.concat_ws(":", F.col("iteration").cast("string"), F.col("id").cast("string")))
    dealt = rows.select("id", "side", F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("iteration")).withColumn("h", hashed)
    dealt = dealt.withColumn("bucket", F.substring("h", 1, digits) if digits else F.lit(""))
    sizes = dealt.groupBy("iteration", "bucket").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("iteration").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("iteration", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    first = rows.filter("side = 0").count()
    rank = F.row_number().over(Window.partitionBy("iteration", "bucket").orderBy("h", "id")) + F.col("before")
    ranked = dealt.join(sizes, ["iteration", "bucket"]).withColumn("r", rank)
    return ranked.select("iteration", "id", F.when(F.col("r") <= first, 0).otherwise(1).alias("side"))


def null_statistics(rows: DataFrame, permutations: DataFrame, name: str = "rbf", gamma: float = 1.0, degree: int = 3, constant: float = 1.0, tile: int = TILE) -> DataFrame:
    """(iteration, m, n, mmd_u): the unbiased squared discrepancy of rows (id, side, x array), as iteration 0, and of each
    of the given ``permutations`` (iteration, id, side).

    Each row carries its sides in all iterations. Rows are dealt to blocks by a hash, each pair of blocks is a task, and
    only sums leave it; kernel values are worked out once for all iterations. An id that an iteration lacks, or ids
    that repeat, are refused by a failing check of the counts.
    """
    every = permutations.select("iteration", "id", "side").unionByName(rows.select(F.lit(0).alias("iteration"), "id", "side"))
    wide = every.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("iteration", "side"))).alias("s"))
    numbers = [r[0] for r in every.select("iteration").distinct().orderBy("iteration").collect()]  # one an iteration
    good = F.transform("s", lambda x: x["iteration"]) == F.array(*[F.lit(i) for i in numbers])
    sides = F.when(good, F.transform("s", lambda x: x["side"].cast("int"))).otherwise(F.raise_error(F.lit("an iteration must hold each id once")))
    blocks = max(1, math.ceil(rows.count() / tile))
    placed = rows.select("id", "x").join(wide.select("id", sides.alias("sides")), "id").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    a = placed.withColumn("other", F.explode(others)).select(F.col("block").alias("ab"), F.col("other").alias("bb"), F.lit(True).alias("first"), "id", "x", "sides")
    b = placed.withColumn("other", F.explode(others)).select(F.col("other").alias("ab"), F.col("block").alias("bb"), F.lit(False).alias("first"), "id", "x", "sides")

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x, y = part[part["first"]], part[~part["first"]]
        out = pd.DataFrame({"iteration": np.array(numbers, np.int32)})
        if not len(x) or not len(y):
            return out.assign(**dict.fromkeys(("xx", "yy", "xy", "m", "n"), 0.0))
        k = kernel(name, np.stack(x["x"].to_list()), np.stack(y["x"].to_list()), gamma, degree, constant)
        k = np.where(x["id"].to_numpy()[:, None] == y["id"].to_numpy()[None, :], 0.0, k)
        u, v = (np.stack(s["sides"].to_list()).astype(float) for s in (x, y))
        ones = [((1 - u) * (k @ (1 - v))).sum(0), (u * (k @ v)).sum(0)]
        own = key[0] == key[1]
        cross = ((1 - u) * (k @ v)).sum(0)
        return out.assign(xx=ones[0], yy=ones[1], xy=cross, m=(1 - u).sum(0) if own else 0.0, n=u.sum(0) if own else 0.0)

    each = a.unionByName(b).groupBy("ab", "bb").applyInPandas(run, "iteration int, xx double, yy double, xy double, m double, n double")
    sums = each.groupBy("iteration").agg(*[F.sum(c).alias(c) for c in ("xx", "yy", "xy", "m", "n")])
    m, n = F.col("m"), F.col("n")
    stat = F.col("xx") / (m * (m - 1)) + F.col("yy") / (n * (n - 1)) - 2 * F.col("xy") / (m * n)
    return sums.select("iteration", m.cast("bigint").alias("m"), n.cast("bigint").alias("n"), stat.alias("mmd_u"))


def two_sample_test(statistics: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(iterations, statistic, p_value, null_mean, null_deviation, chebyshev_accepts) from ``null_statistics``; one row.

    The p-value is the share of iterations with a larger statistic, no less than one of them.
    """
    null, own = F.col("iteration") > 0, F.col("iteration") == 0
    wide = statistics.crossJoin(F.broadcast(statistics.filter(own).select(F.col("mmd_u").alias("statistic")))).filter(null)  # one row
    found = wide.groupBy("statistic").agg(
        F.count("*").alias("iterations"),
        F.avg((F.col("mmd_u") > F.col("statistic")).cast("double")).alias("share"),
        F.avg("mmd_u").alias("null_mean"),
        F.stddev_pop("mmd_u").alias("null_deviation"),
    )
    accepts = chebyshev(F.col("statistic"), F.col("null_mean"), F.col("null_deviation"), alpha)
    return found.select("iterations", "statistic", F.greatest(1 / F.col("iterations"), "share").alias("p_value"), "null_mean", "null_deviation", accepts.alias("chebyshev_accepts"))


def chebyshev(stat: Column, mean: Column, deviation: Column, alpha: float) -> Column:
    """Whether Chebyshev's inequality accepts that both samples are of one distribution."""
    return F.abs(stat - mean) < deviation / math.sqrt(alpha)


def relation(rear: Column, front: Column, both: Column, sides: Column, p_front: Column, p_rear: Column) -> Column:
    """How an event relates to a series, from which windows around it differ.

    ``rear``, ``front``, ``both``: whether these differ from windows elsewhere; ``sides``: whether they differ from
    each other.
    """
    strong = F.when(p_front < p_rear, "S -->* E").otherwise("E -->* S")
    return (
        F.when(rear & ~front, "E --> S")
        .when(~rear & front, "S --> E")
        .when(rear & front, strong)
        .when(both, "S;E")
        .when(sides, "S?E")
        .otherwise("S!E")
    )


def event_relations(series: DataFrame, events: DataFrame, w: int, samples: int = 50, iterations: int = 100, alpha: float = 0.05, alpha_set: float = 0.05, seed: int = 0) -> DataFrame:
    """(event_id, series_id, relation, p_front, p_rear, p_both, min_p) of events (event_id, series_id, loc).

    The windows of w samples before and from an event are tested against ``samples`` windows that start at seeded random
    places, and against each other. Windows elsewhere come from a join on their starts; a task sees one event's windows.
    """
    size = series.groupBy("series_id").agg(F.max("i").alias("last"))
    spans = events.join(size, "series_id").filter((F.col("loc") >= w) & (F.col("loc") + w <= F.col("last") + 1))
    draws = spans.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    start = F.pmod(F.xxhash64("event_id", "k", F.lit(seed)), F.greatest(F.lit(1), F.col("last") + 1 - w))
    wanted = draws.select("event_id", "series_id", "k", start.alias("start")).unionByName(
        spans.select("event_id", "series_id", F.explode(F.array(F.struct(F.lit(-1).alias("k"), (F.col("loc") - w).alias("start")), F.struct(F.lit(0).alias("k"), F.col("loc").alias("start")))).alias("x")).select("event_id", "series_id", "x.*")
    )
    near = wanted.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / w), F.floor((F.col("start") + w - 1) / w))))
    rows = near.join(series.withColumn("block", F.floor(F.col("i") / w)), ["series_id", "block"]).filter((F.col("i") >= F.col("start")) & (F.col("i") < F.col("start") + w))
    windows = rows.groupBy("event_id", "series_id", "k").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("s")).select("event_id", "series_id", "k", F.expr("transform(s, x -> x.v)").alias("x"))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        by = {int(k): np.asarray(x, float) for k, x in zip(part["k"], part["x"], strict=True)}
        front, rear = by.pop(-1), by.pop(0)
        pooled = np.concatenate(list(by.values()))
        gamma = 1 / max(float(pooled.var()), 1e-12)

        def against(x):
            p = [permutation_test(x, o, gamma=gamma, iterations=iterations, seed=seed)["p_value"] for o in by.values()]
            return 1 - float(np.mean(np.array(p) < alpha))

        both = np.concatenate([front, rear])
        d = np.abs(both[:, None] - both[None, :])
        median = float(np.median(d[np.triu_indices(len(both), 1)])) or 1.0
        p_sides = permutation_test(front, rear, gamma=1 / median**2, iterations=iterations, seed=seed)["p_value"]
        return pd.DataFrame([(key[0], key[1], against(front), against(rear), against(both), p_sides)], columns=["event_id", "series_id", "p_front", "p_rear", "p_both", "p_sides"])

    tested = windows.groupBy("event_id", "series_id").applyInPandas(run, "event_id bigint, series_id string, p_front double, p_rear double, p_both double, p_sides double")
    low = {c: F.col(f"p_{c}") < alpha_set for c in ("front", "rear", "both")}
    found = relation(low["rear"], low["front"], low["both"], F.col("p_sides") < alpha, F.col("p_front"), F.col("p_rear"))
    return tested.select("event_id", "series_id", found.alias("relation"), "p_front", "p_rear", "p_both", F.least("p_front", "p_rear", "p_both").alias("min_p"))
