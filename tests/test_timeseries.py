import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from relispan.operators import timeseries, twosample
from relispan.streaming import profile, run

VALUES = [0, 1, 3, 2, 9, 1, 14, 15, 1, 2, 2, 10, 7]
ROBUST = [0.85695683, 0.1767767, 0.77055175, 0.99215674, 1.42521928, 1.6955825, 2.25, 1.74553001, 0.1767767, 0.77055175]
STANDARD = [1.361339, 0.280823, 1.224078, 1.576114, 2.264065, 2.693557, 3.57429, 2.772902, 0.280823, 1.224078]
FIRST_EIGHT = [0.741152, 0.152888, 0.666423, 0.858082, 1.232622, 1.46645, 1.945946, 1.509648, 0.152888, 0.666423]


def series(spark, values=VALUES, name="a"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(values)], "series_id string, i bigint, v double")


@pytest.mark.parametrize(("norm", "want"), [("robust", ROBUST), (None, STANDARD)])
def test_profile_of_the_fixture(spark, norm, want):
    s = series(spark)
    got = timeseries.matrix_profile(timeseries.apply_scale(s, timeseries.fit_scale(s, norm)), 4).orderBy("i").collect()
    assert np.allclose([r["p"] for r in got], want, atol=1e-5)


def test_scale_is_fitted_on_earlier_samples(spark):
    s = series(spark)
    fitted = timeseries.fit_scale(s.filter("i < 8"))
    got = timeseries.matrix_profile(timeseries.apply_scale(s, fitted), 4).orderBy("i").collect()
    assert np.allclose([r["p"] for r in got], FIRST_EIGHT, atol=1e-5)
    with pytest.raises(ValueError):
        timeseries.fit_scale(s, "other")


def slow_profile(v, m, zone, z=False):
    w = np.lib.stride_tricks.sliding_window_view(np.asarray(v, float), m)
    if z:
        w = (w - w.mean(1, keepdims=True)) / w.std(1, keepdims=True)
    d = np.sqrt(((w[:, None] - w[None]) ** 2).sum(2))
    d[np.abs(np.subtract.outer(np.arange(len(w)), np.arange(len(w)))) <= zone] = np.inf
    return d.min(1), d.argmin(1)


@pytest.mark.parametrize("z", [False, True])
def test_tiles_agree_with_all_pairs(spark, z):
    v = np.random.RandomState(0).randn(150).cumsum()
    got = timeseries.matrix_profile(series(spark, v), 8, znorm=z, tile=32).orderBy("i").collect()
    p, nn = slow_profile(v, 8, 2, z)
    assert np.allclose([r["p"] for r in got], p) and [r["nn"] for r in got] == nn.tolist()
    for r in got:
        assert r["p"] == pytest.approx(min(x for x in (r["left_p"], r["right_p"]) if x is not None))
    part = timeseries.matrix_profile(series(spark, v), 8, znorm=z, tile=32, share=0.3).collect()
    assert all(r["p"] is None or r["p"] >= p[r["i"]] - 1e-9 for r in part)


def test_join_of_two_series(spark):
    rng = np.random.RandomState(1)
    a, b = rng.randn(40), rng.randn(60)
    got = timeseries.matrix_profile(series(spark, a), 5, other=series(spark, b), tile=16).orderBy("i").collect()
    x, y = (np.lib.stride_tricks.sliding_window_view(s, 5) for s in (a, b))
    assert np.allclose([r["p"] for r in got], np.sqrt(((x[:, None] - y[None]) ** 2).sum(2)).min(1))


def test_short_and_empty_series(spark):
    assert not timeseries.matrix_profile(series(spark, [1, 2]), 4).collect()
    assert not timeseries.matrix_profile(series(spark).limit(0), 4).collect()
    one = timeseries.matrix_profile(series(spark, [1, 2, 3, 4]), 4).collect()
    assert [r["p"] for r in one] == [None]


def test_discords_intervals_and_k_of_n(spark):
    p = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 5.0), ("a", 2, 6.0), ("a", 9, 5.5), ("b", 0, 2.0), ("b", 1, 5.0)], "series_id string, i bigint, p double")
    assert [tuple(r) for r in timeseries.discords(p, 1).orderBy("series_id").collect()] == [("a", 1, 2, 6.0), ("b", 1, 1, 5.0)]
    runs = timeseries.anomaly_intervals(p, 3, F.lit(4.0)).orderBy("series_id", "first").collect()
    assert [tuple(r) for r in runs] == [("a", 1, 4, 2, 6.0), ("a", 9, 11, 1, 5.5), ("b", 1, 3, 1, 5.0)]
    assert [tuple(r) for r in timeseries.k_of_n(p).filter("i = 1").orderBy("k").collect()] == [(1, 1, 5.0, "a"), (1, 2, 5.0, "b")]


def test_windows_and_t_scores(spark):
    v = [1.0, 2.0, 3.0, 9.0, 8.0, 7.0, 1.0]
    e = spark.createDataFrame([(1, "a", 3), (2, "a", 6)], "event_id bigint, series_id string, loc bigint")
    w = timeseries.event_windows(series(spark, v), e, 3)
    assert {(r["side"], r["i"]) for r in w.filter("event_id = 1").collect()} == {("front", 0), ("front", 1), ("front", 2), ("rear", 3), ("rear", 4), ("rear", 5)}
    got = {r["event_id"]: r["t"] for r in timeseries.t_scores(w).collect()}
    assert got[1] == pytest.approx((2 - 8) / math.sqrt((2 / 3 + 2 / 3) / 3)) and got[2] is None


def test_stream_equals_batch(spark):
    rng = np.random.RandomState(2)
    v = {n: rng.randn(60) for n in "ab"}
    batch = {(r["series_id"], r["i"]): r["p"] for n in v for r in timeseries.matrix_profile(series(spark, v[n], n), 6).collect()}
    from relispan.plans.shared import shared_dir

    folder = f"{shared_dir(spark)}/series"
    whole = series(spark, v["a"], "a").unionByName(series(spark, v["b"], "b"))
    for k in range(3):
        whole.filter(f"i >= {20 * k} and i < {20 * k + 20}").coalesce(1).write.mode("append").parquet(folder)
    stream = run.read_files(spark, folder, "*.parquet", whole.schema, 1)
    rows = run.run_now(profile.incremental_profile(stream, 6), "update")
    got = {(r["series_id"], r["i"]): r["r"]["p"] for r in rows.groupBy("series_id", "i").agg(F.max(F.struct("batch", "p")).alias("r")).collect()}
    assert got.keys() == batch.keys() and all(got[k] == pytest.approx(batch[k]) for k in got)


def samples(shift):
    rng = np.random.RandomState(0)
    return rng.multivariate_normal([0, 0], np.eye(2), 200), rng.multivariate_normal([shift, shift], np.eye(2), 200)


@pytest.mark.parametrize(("shift", "want"), [(0, -0.0032396905173185386), (1, 0.19124120543500756)])
def test_mmd_of_the_fixture(spark, shift, want):
    rng = np.random.RandomState(0)
    x = rng.multivariate_normal(np.zeros(2), np.eye(2), 200)
    y = rng.multivariate_normal(np.full(2, shift), np.eye(2), 200)
    both = np.vstack([x, y])
    d = np.sqrt(((both[:, None] - both[None]) ** 2).sum(2))
    gamma = 1 / np.median(d[np.triu_indices(400, 1)]) ** 2
    here = twosample.mmd_unbiased(twosample.kernel("rbf", both, both, gamma), 200)
    rows = spark.createDataFrame([(i, int(i >= 200), r.tolist()) for i, r in enumerate(both)], "id bigint, side int, x array<double>")
    got = twosample.mmd(twosample.kernel_sums(rows, "rbf", gamma, tile=64)).first()
    assert got["mmd_u"] == pytest.approx(here) and got["m"] == got["n"] == 200
    assert here == pytest.approx(want, abs=0.02)


def test_permutations_and_kernels():
    x, y = samples(1)
    res = twosample.permutation_test(x, y, gamma=0.3, iterations=100)
    assert res["p_value"] == 0.01 and not res["chebyshev_accepts"]
    same = twosample.permutation_test(x[:100], x[100:], gamma=0.3, iterations=100)
    assert same["p_value"] > 0.05 and same["chebyshev_accepts"]
    a = np.abs(x[:5])
    for name in twosample.KERNELS:
        assert twosample.kernel(name, a, a).shape == (5, 5)
    with pytest.raises(ValueError):
        twosample.kernel("none", a, a)


@pytest.mark.parametrize(("rear", "front", "both", "sides", "want"), [(1, 0, 0, 0, "E --> S"), (0, 1, 0, 0, "S --> E"), (1, 1, 0, 0, "S -->* E"), (0, 0, 1, 0, "S;E"), (0, 0, 0, 1, "S?E"), (0, 0, 0, 0, "S!E")])
def test_relation_table(spark, rear, front, both, sides, want):
    lit = lambda x: F.lit(bool(x))
    got = spark.range(1).select(twosample.relation(lit(rear), lit(front), lit(both), lit(sides), F.lit(0.1), F.lit(0.2))).first()[0]
    assert got == want


def test_events_at_the_edges_of_a_pulse(spark):
    rng = np.random.RandomState(0)
    v = 0.3 + rng.randn(900) * 0.005
    v[300:380] = 0.9
    e = spark.createDataFrame([(1, "a", 300), (2, "a", 600)], "event_id bigint, series_id string, loc bigint")
    got = {r["event_id"]: r["relation"] for r in twosample.event_relations(series(spark, v), e, 30, samples=12, iterations=40).collect()}
    assert got[1] in ("E --> S", "E -->* S") and got[2] in ("S!E", "S?E")


def test_given_permutations_against_numpy(spark):
    from relispan.operators import twosample

    draw = np.random.RandomState(5)
    x = draw.randn(30, 3)
    sides = np.array([0] * 14 + [1] * 16)
    rows = spark.createDataFrame([(i, int(s), v.tolist()) for i, (s, v) in enumerate(zip(sides, x))], "id bigint, side int, x array<double>")
    orders = [draw.permutation(30) for _ in range(6)]
    given = spark.createDataFrame([(k + 1, int(i), 0 if at < 14 else 1) for k, o in enumerate(orders) for at, i in enumerate(o)], "iteration int, id bigint, side int")
    k = twosample.kernel("rbf", x, x, gamma=0.3)
    want = [twosample.mmd_unbiased(k, 14)] + [twosample.mmd_unbiased(k[np.ix_(o, o)], 14) for o in orders]
    for tile in (1024, 7):
        stats = twosample.null_statistics(rows, given, gamma=0.3, tile=tile)
        got = {r["iteration"]: r for r in stats.collect()}
        assert [got[i]["mmd_u"] for i in range(7)] == pytest.approx(want) and {(r["m"], r["n"]) for r in got.values()} == {(14, 16)}
    test = twosample.two_sample_test(stats).first()
    assert test["p_value"] == pytest.approx(max(1 / 6, np.mean(np.array(want[1:]) > want[0]))) and test["iterations"] == 6
    with pytest.raises(Exception, match="each id once"):
        twosample.null_statistics(rows, given.filter("NOT (iteration = 2 AND id = 3)")).collect()


def test_permutations_by_buckets_equal_one_order(spark):
    from relispan.operators import twosample

    rows = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "id bigint, side int")
    key = lambda r: (r["iteration"], r["id"], r["side"])
    one, many = (sorted(map(key, twosample.hash_permutations(rows, 3, bucket_rows=b).collect())) for b in (4096, 5))
    assert one == many and sum(s for i, _, s in one if i == 1) == 67


def test_fast_permutations_equal_plain_ones():
    from relispan.operators import twosample

    draw = np.random.RandomState(1)
    x, y = draw.randn(9, 2), draw.randn(7, 2) + 1
    got = twosample.permutation_test(x, y, iterations=20, seed=4, gamma=0.5)
    k = twosample.kernel("rbf", np.vstack([x, y]), np.vstack([x, y]), gamma=0.5)
    again = np.random.RandomState(4)
    want = [twosample.mmd_unbiased(k[np.ix_(o, o)], 9) for o in (again.permutation(16) for _ in range(20))]
    assert got["null"] == pytest.approx(want)
