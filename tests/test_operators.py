"""Operators that SQL can't express, against plain versions; and the edges of the others."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import Regimes
from tidemark.functions import equations
from tidemark.operators import clustering, decode, events, predictors, samples, segments, signal, structure, windows


def table(spark, xs, channel="a"):
    return spark.createDataFrame([(channel, i, x) for i, x in enumerate(xs)], "channel string, idx long, x double").withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(idx as int))"))


def brute_peaks(s):
    out = []
    for i in range(1, len(s) - 1):
        p, c, n = s[i - 1 : i + 2]
        if None in (p, c, n) or not (p < c >= n or p > c <= n):
            continue
        up = p < c
        left = right = i
        while left > 0 and s[left - 1] is not None and (s[left - 1] <= s[left] if up else s[left - 1] >= s[left]):
            left -= 1
        while right < len(s) - 1 and s[right + 1] is not None and (s[right + 1] <= s[right] if up else s[right + 1] >= s[right]):
            right += 1
        out.append((i, "max" if up else "min", left, right))
    return out


@pytest.mark.parametrize("xs", [[1, 2, 2, 2, 1], [3, 1, 1, 3], [1, 2, 2, 3, 1], [1, 3, 2, None, 2, 1], [], [1], [None, None], list(np.random.default_rng(0).integers(0, 5, 200))])
def test_peaks_walk_to_their_feet(spark, xs):
    s = [None if x is None else float(x) for x in xs]
    df = table(spark, s).withColumns({"s": F.col("x"), "d1": F.lit(None).cast("double"), "d2": F.lit(None).cast("double")})
    got = sorted((r.idx, r.sign, r.left_idx, r.right_idx) for r in events.peaks(df).collect())
    assert got == brute_peaks(s)


def test_savgol_ends_lie_on_the_quadratic(spark):
    y = np.random.default_rng(1).normal(size=20)
    got = [r.s for r in signal.savgol(table(spark, y.tolist())).orderBy("idx").collect()]
    t = np.arange(7)
    first, last = np.polyval(np.polyfit(t, y[:7], 2), t), np.polyval(np.polyfit(t, y[-7:], 2), t)
    assert np.allclose(got[:4], first[:4]) and np.allclose(got[-4:], last[-4:])
    assert [r.s for r in signal.savgol(table(spark, [1.0, None, 3.0])).orderBy("idx").collect()] == [1.0, 2.0, 3.0]


def test_unknown_smoothing(spark):
    with pytest.raises(ValueError):
        signal.signal(table(spark, [1.0]), method="other")


def test_windows_of_short_series(spark):
    sig = signal.signal(table(spark, [1.0] * 10))
    assert windows.intra_features(sig, 24).count() == 0
    assert windows.intra_features(sig, 4, 3).count() == 3
    r = windows.intra_features(signal.signal(table(spark, [None] * 4)), 4).first()
    assert [r[c] for c in windows.INTRA] == [0.0] * 13


def test_window_count_and_samples():
    n, length, horizon, count, history = 54_025, 24, 24, 24, 4
    assert n - length + 1 == 54_002 and 54_002 - (history - 1) - (horizon + count - 1) == 53_952
    assert samples.target_count() == 24 and samples.target_count("predictor") == 4 and samples.target_count("new_physics") == 3


def test_ranges_bridge(spark):
    e = spark.createDataFrame([(i,) for i in range(200)], "idx long")
    r = spark.createDataFrame([(0, 3, 150), (1, 60, 70), (2, 9, 8), (3, 190, 400)], "range_id long, start_idx long, end_idx long")
    got = {(x.range_id, x.idx) for x in windows.ranges_bridge(e, r).collect()}
    assert got == {(k, i) for k, a, z in [(0, 3, 150), (1, 60, 70), (3, 190, 400)] for i in range(200) if a <= i <= z}


def slow_runs(labels, least):
    v = list(labels)
    while True:
        runs, a = [], 0
        for i in range(1, len(v) + 1):
            if i == len(v) or v[i] != v[a]:
                runs.append((a, i, v[a]))
                a = i
        for k, (a, z, x) in enumerate(runs):
            left = runs[k - 1][2] if k else -1
            right = runs[k + 1][2] if k + 1 < len(runs) else -1
            new = left if left != -1 else right
            if x != -1 and z - a < least and new not in (-1, x):
                v[a:z] = [new] * (z - a)
                break
        else:
            return v


def test_short_runs_melt_in_order():
    rng = np.random.default_rng(2)
    for _ in range(300):
        v = np.repeat(rng.integers(-1, 4, 12), rng.integers(1, 5, 12))
        assert predictors.without_short_runs(v, 3).tolist() == slow_runs(v, 3)


def test_merged_ranges():
    assert predictors.merged_ranges([(0, 1), (2, 9), (10, 12), (13, 30)], 6) == [(0, 12), (13, 30)]
    assert predictors.merged_ranges([(0, 1)], 6) == [(0, 1)] and predictors.merged_ranges([], 6) == []


def test_ar2_has_least_norm_on_flat_windows():
    assert np.allclose(predictors.ar2_predictions(np.full((2, 24), 5.0)), 5.0)
    x = [1.0, 2.0]
    for _ in range(30):
        x.append(0.5 + 0.6 * x[-1] + 0.2 * x[-2])
    assert np.allclose(predictors.ar2_predictions(np.array([x[:-1][-24:]])), x[-1])


def test_regimes_cover_the_series(spark):
    rng = np.random.default_rng(3)
    df = table(spark, rng.normal(size=150).tolist(), "a").unionByName(table(spark, rng.normal(size=150).tolist(), "b"))
    labels = predictors.labelled(signal.signal(df))
    blocks = sorted((r.start_idx, r.end_idx) for r in predictors.regimes(labels).collect())
    assert blocks[0][0] == 24 and blocks[-1][1] == 149 and all(a[1] + 1 == b[0] for a, b in zip(blocks, blocks[1:], strict=False))
    assert all(z - a + 1 >= Regimes().min_length for a, z in blocks)
    assert all(r.end_idx - r.start_idx == 23 for r in predictors.windows_in_blocks(predictors.regimes(labels)).collect())


def test_unwrap(spark):
    deg = [350.0, 10.0, 20.0, 340.0, 200.0, 20.0]
    got = [r.u for r in table(spark, deg).withColumn("u", predictors.unwrapped(F.col("x"))).orderBy("idx").collect()]
    assert np.allclose(got, np.unwrap(deg, period=360))


def test_fits_find_their_own_equations():
    t = np.arange(60.0)
    w = equations.OMEGA
    for kind, y in {
        "exponential": 3 + 5 * np.exp(-0.2 * t),
        "harmonic": 2 + np.cos(w * t) - 3 * np.sin(w * t),
        "linear_harmonic": 2 + 0.5 * t + np.cos(w * t),
        "damped_harmonic": 1 + np.exp(-0.05 * t) * (4 * np.cos(w * t) + np.sin(w * t)),
    }.items():
        f = equations.best_fit(y)
        assert f.rms < 1e-6, (kind, f)
        assert np.allclose(f.at(t), y, atol=1e-5)
    assert equations.best_fit(np.array([4.0])).eq_type == "constant"
    assert equations.best_fit(np.array([1.0, 3.0]), equations.PLAIN_SET).eq_type == "linear"
    assert equations.best_fit(np.array([np.nan])).n_points == 0


def test_walk_tiles_the_series_within_tolerance(spark):
    rng = np.random.default_rng(4)
    y = np.concatenate([np.full(40, 2.0), 10 + 0.5 * np.arange(50), np.full(5, -3.0)]) + rng.normal(scale=0.05, size=95)
    got = segments.segmented(table(spark, y.tolist()), 1.0, harmonic=False).orderBy("segment_id").collect()
    assert got[0].start_idx == 0 and got[-1].end_idx == 94 and all(a.end_idx + 1 == b.start_idx for a, b in zip(got, got[1:], strict=False))
    assert 40 in [r.start_idx for r in got]
    again = segments.walk(y, 1.0, 24, equations.PLAIN_SET, 5.0)
    assert [(a, z) for a, z, _ in again] == [(r.start_idx, r.end_idx) for r in got]


def test_dynamics():
    t = np.arange(80.0)
    assert equations.fit_dynamics(np.exp(-0.02 * t) * np.sin(0.5 * t))["kind"] == "oscillatory"
    assert equations.fit_dynamics(np.full(20, 3.0))["kind"] == "level"
    assert equations.fit_dynamics(np.array([np.nan, np.nan]))["std"] == 0.0


def test_decoded_chain_with_and_without_a_floor(spark):
    rows = [("a", 0, 3, "linear", 0.0, 1.0, 0.0, 0.0, 0.0), ("a", 1, 4, "linear", 9.0, -2.0, 0.0, 0.0, 0.0)]
    s = spark.createDataFrame(rows, "channel string, segment_id long, duration long, eq_type string, L double, c double, lam double, A double, B double")
    free = [r.value for r in segments.decoded(s, 1.0, 100).orderBy("idx").collect()]
    assert free == [1.0, 2.0, 3.0, 3.0, 1.0, -1.0, -3.0]
    assert [r.value for r in segments.decoded(s, 1.0, 6, at_least=0.0).orderBy("idx").collect()] == [1.0, 2.0, 3.0, 3.0, 1.0, 0.0]


def test_interpolation_between_points(spark):
    p = spark.createDataFrame([(0.0, 1.0), (2.0, 5.0)], "t double, v double")
    g = spark.createDataFrame([(-1.0,), (0.0,), (0.5,), (2.0,), (9.0,)], "t double")
    assert [r.v for r in decode.interpolated(p, g).orderBy("t").collect()] == [1.0, 1.0, 2.0, 5.0, 5.0]


def test_clustering_parts(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 0.1, size=(40, 3)) for m in (0, 5, 10)])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    labels, table_ = clustering.kmeans(points, 3, seed=1)
    assert labels.count() == 120 and table_.count() == 3
    d = clustering.pairwise(x)
    k, medoids = clustering.kmedoids(d, 3, seed=3)
    assert len(medoids) == 3 and clustering.silhouette(d, np.repeat([0, 1, 2], 40)) > 0.9
    now = clustering.Leaders(2.0, 3)
    got = [now.add(r) for r in x]
    assert now.n == 3 and [len(set(got[a : a + 40])) for a in (0, 40, 80)] == [1, 1, 1] and now.counts[:3].tolist() == [40, 40, 40]
    to, weights, means = clustering.merged_down(np.arange(10), np.ones(10), rng.normal(size=(10, 2)), 4)
    assert len(weights) == len(means) == 4 and weights.sum() == 10 and sorted(set(to)) == [0, 1, 2, 3]
    to, weights, means = clustering.merged_down(np.arange(4), np.array([30.0, 30, 1, 2]), np.array([[0.0], [10], [1], [12]]), 2)
    assert to.tolist() == [0, 1, 0, 1] and weights.tolist() == [31, 32] and np.allclose(means[:, 0], [1 / 31, 324 / 32])


def test_asof_and_split(spark):
    left = spark.createDataFrame([(1, 5), (2, 10), (3, 11)], "window_id long, at long")
    right = spark.createDataFrame([(5, 0), (10, 1)], "start_idx long, pos long")
    assert {r.window_id: r.pos for r in samples.forward_asof(left, right).collect()} == {1: 0, 2: 1, 3: None}
    n = {r.split: r["count"] for r in samples.chronological_split(spark.range(100).withColumnRenamed("id", "k"), "k").groupBy("split").count().collect()}
    assert n == {"train": 70, "validation": 15, "test": 15}


def test_empty_events(spark, data):
    e = spark.read.parquet(f"{data}/events.parquet").limit(0)
    s = signal.signal(signal.hourly_grid(e))
    assert s.count() == 0 and events.peaks(s).count() == 0 and windows.intra_features(s).count() == 0


def test_dynamics_vectors_and_distances(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(4):
        for channel in "ab":
            kind = ["level", "linear", "exponential", "oscillatory"][rng.integers(4)]
            rows.append((k, channel, kind, *map(float, rng.random(6)), k % 3))
    df = spark.createDataFrame(rows, "segment_id long, channel string, kind string, L double, c double, lam double, omega double, A double, B double, synchrony long")
    back = df.withColumn("d", structure.dynamics_of(structure.dynamics_vector(F.col("kind")))).select("*", "d.*").collect()
    assert all(r[2:9] == tuple(r)[11:] for r in map(tuple, back))
    v = {r.segment_id: np.array(r.v) for r in structure.functional_vectors(df).collect()}
    t = np.linspace(0, 1, 100)
    names = ["kind", *structure.PARAMS]
    fits = {(r[0], r[1]): dict(zip(names, r[2:9], strict=True)) for r in rows}
    for i in range(4):
        for j in range(i):
            want = sum(np.trapezoid((equations.dynamics_value(fits[i, c], t) - equations.dynamics_value(fits[j, c], t)) ** 2, t) for c in "ab") + (i % 3 - j % 3) ** 2
            assert np.isclose(((v[i] - v[j]) ** 2).sum(), want)
    one = df.filter("segment_id = 0 and channel = 'a'").withColumn("d", F.struct("kind", *structure.PARAMS))
    r = one.select(structure.forward(F.col("d"), F.lit(5.0), F.lit(2.0), 3).alias("f"), structure.chained(F.array("d", "d"), F.lit(5.0), F.lit(2.0)).alias("c")).first()
    step = 2 * equations.dynamics_value(fits[0, "a"], np.arange(1, 4.0))
    assert np.allclose(r.f, 5 + step) and np.allclose(r.c, [5 + step[0], 5 + 2 * step[0]])


def test_resampled(spark):
    df = spark.createDataFrame([([],), ([2.0],), ([0.0, 1.0],), ([0.0, 4.0, 2.0],)], "v array<double>")
    got = [r[0] for r in df.select(structure.resampled(F.col("v"), 5)).collect()]
    assert got == [[0.0] * 5, [2.0] * 5, [0.0, 0.25, 0.5, 0.75, 1.0], [0.0, 2.0, 4.0, 3.0, 2.0]]
