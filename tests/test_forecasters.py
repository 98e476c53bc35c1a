"""Blocks of tensors, models fitted on them against a loop in one process, the SQL functions, and writes that count as they go."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_streams import two_series
from tidemark.functions import equations, sql
from tidemark.operators import forecasters, segments
from tidemark.plans import catalog
from tidemark.sources import sinks

SHAPE = forecasters.Shape(3, 2, 4)


def some_samples(n=150, seed=0):
    """Targets that the history tells, but for some noise."""
    rng = np.random.default_rng(seed)
    h = rng.normal(size=(n, 3, 4))
    t = np.stack([h[:, 2] * 0.5 + h[:, 0], -h[:, 2]], axis=1) + rng.normal(scale=0.1, size=(n, 2, 4))
    return h, t


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    h, t = some_samples()
    df = spark.createDataFrame([(i * 3, h[i].tolist(), t[i].tolist()) for i in range(150)], "source_window_id long, history array<array<double>>, target array<array<double>>").repartition(5)
    return forecasters.tensor_blocks(df, SHAPE, str(tmp_path_factory.mktemp("b") / "blocks"), rows=16)


def test_blocks_hold_the_samples(stored):
    h, t = some_samples()
    rows = sorted(stored.collect(), key=lambda r: r.block)
    assert [r.block for r in rows] == list(range(10)) and [r.n for r in rows] == [16] * 9 + [6]
    parts = [forecasters.tensors(r, SHAPE) for r in rows]
    ids, history, target = (np.concatenate([p[k] for p in parts]) for k in range(3))
    assert ids.tolist() == [i * 3 for i in range(150)]
    assert np.array_equal(history, h.astype("f4")) and np.array_equal(target, t.astype("f4"))


@pytest.mark.parametrize("history, target", [([[1.0] * 4] * 2, [[1.0] * 4] * 2), ([[1.0] * 4] * 3, [[1.0] * 4, [1.0] * 5]), (None, [[1.0] * 4] * 2), ([[1.0, None, 1.0, 1.0]] * 3, [[1.0] * 4] * 2), ([[float("nan")] * 4] * 3, [[1.0] * 4] * 2), ([None] * 3, [[1.0] * 4] * 2)])
def test_a_sample_of_another_shape_is_an_error(spark, tmp_path, history, target):
    good = ([[1.0] * 4] * 3, [[1.0] * 4] * 2)
    df = spark.createDataFrame([(1, *good), (2, history, target)], "source_window_id long, history array<array<double>>, target array<array<double>>")
    with pytest.raises(ValueError, match="of 2 samples"):
        forecasters.tensor_blocks(df, SHAPE, str(tmp_path / "b"))


def test_gradient_by_differences():
    h, t = some_samples(7, 1)
    m = forecasters.Recurrent(SHAPE, hidden=5)
    m.scale = {"mean": np.full(4, 0.1), "std": np.full(4, 1.3), "target_mean": np.zeros(4), "target_std": np.full(4, 0.9)}
    rng = np.random.default_rng(2)
    m.weights = {k: rng.normal(scale=0.5, size=v.shape) for k, v in m.start().items()}
    _, g = m.gradient(h, t)
    for k, w in m.weights.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in w.shape)
            old, e = w[at], []
            for x in (1e-5, -1e-5):
                w[at] = old + x
                e.append(m.gradient(h, t)[0])
            w[at] = old
            assert np.isclose((e[0] - e[1]) / 2e-5, g[k][at], rtol=1e-5, atol=1e-6), k


def test_fit_is_that_of_one_process(spark, stored):
    """The same batches, one block after another, in plain numpy."""
    m = forecasters.Recurrent(SHAPE, hidden=6, epochs=3, batches=2).fit(stored.repartition(4))
    rows = stored.orderBy("block").collect()
    own = forecasters.Recurrent(SHAPE, hidden=6, epochs=3, batches=2)
    own.scale = {}
    x, y = (np.concatenate([forecasters.tensors(r, SHAPE)[k] for r in rows]).reshape(-1, 4).astype(float) for k in (1, 2))
    own.scale = {"mean": x.mean(0), "std": x.std(0), "target_mean": y.mean(0), "target_std": y.std(0)}
    own.weights, moving = own.start(), forecasters.Adam(own.rate, own.decay)
    for epoch in range(3):
        for batch in range(2):
            inside = {r.block for r in stored.filter(forecasters.in_batch(epoch, batch, 2)).select("block").collect()}
            parts = [forecasters.tensors(r, SHAPE) for r in rows if r.block in inside]
            if parts:
                g = [own.gradient(a.astype(float), b.astype(float))[1] for _, a, b in parts]
                moving.step(own.weights, {k: sum(v[k] for v in g) / sum(b.size for *_, b in parts) for k in own.weights})
    assert all(np.allclose(m.weights[k], own.weights[k], rtol=1e-6, atol=1e-9) for k in own.weights)
    assert all(np.allclose(m.scale[k], own.scale[k]) for k in own.scale)


def test_forecasts_beat_the_last_window_and_come_back_from_files(spark, stored, tmp_path):
    m = forecasters.Recurrent(SHAPE, hidden=16, epochs=30, batches=2).fit(stored)
    h, t = some_samples(60, 9)
    assert np.abs(m.forecast(h) - t).mean() < 0.5 * np.abs(forecasters.LastWindow(SHAPE).forecast(h) - t).mean()
    m.save(spark, str(tmp_path / "model"))
    back = forecasters.Recurrent(SHAPE, hidden=16).load(spark, str(tmp_path / "model"))
    assert np.array_equal(back.forecast(h), m.forecast(h))
    table = spark.createDataFrame([(7, [9.0] * 4), (2, [0.0] * 4), (5, [-1.0, 1.0, -1.0, 1.0])], "pattern_id int, v array<double>")
    got = back.predict(stored, table).collect()
    assert len(got) == 300
    known = {7: np.full(4, 9.0), 2: np.zeros(4), 5: np.array([-1.0, 1.0, -1.0, 1.0])}
    for r in got:
        assert r.pattern_id == min(known, key=lambda k: (round(((known[k] - r.prediction) ** 2).sum(), 9), k))
    assert {r.pattern_id for r in back.predict(stored).collect()} == {None}
    errors = {r.step: r for r in forecasters.forecast_errors(back.predict(stored), forecasters.LastWindow(SHAPE).predict(stored)).collect()}
    h, t = some_samples()
    for step in (0, 1):
        off = (h[:, 2] - t[:, step]).astype("f4")
        assert errors[step].n == 150 and np.isclose(errors[step].baseline_mae, np.abs(off).mean(), rtol=1e-5) and np.isclose(errors[step].baseline_rmse, np.sqrt((off**2).mean()), rtol=1e-5)
        assert errors[step].mae < errors[step].baseline_mae


def test_nothing_to_fit_on(stored):
    with pytest.raises(ValueError):
        forecasters.Recurrent(SHAPE).fit(stored.limit(0))


def test_sequence_forecasts_beat_the_last_window(spark):
    got = catalog.sequence_forecasts(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.step for r in got) == list(range(6))
    assert all(r.rmse < r.baseline_rmse and r.mae < r.baseline_mae for r in got)


def test_walk_as_a_table_function(spark):
    series = two_series(spark, 2600)
    sql.register(spark)
    series.createOrReplaceTempView("two_series")
    for tolerance, harmonic in ((3.0, True), (2.0, False)):
        got = spark.sql(f"SELECT * FROM walk_segments(TABLE(two_series) PARTITION BY channel ORDER BY (idx), {tolerance}D, {str(harmonic).lower()})")
        names = ["channel", "segment_id", "start_idx", "end_idx", "duration", "eq_type", "n_points"]
        want = segments.segmented(series, tolerance, harmonic)
        assert sorted(map(tuple, got.select(*names).collect())) == sorted(map(tuple, want.select(*names).collect()))


def test_equations_in_sql(spark):
    sql.register(spark)
    rng = np.random.default_rng(4)
    kinds = [*equations.HARMONIC_SET, "none", None]
    rows = [(k, *map(float, rng.normal(size=5)), float(t)) for k in kinds for t in (0, 3, 17)]
    df = spark.createDataFrame(rows, "eq_type string, L double, c double, lam double, A double, B double, t double")
    df.createOrReplaceTempView("fits")
    for r in spark.sql("SELECT *, segment_value(eq_type, L, c, lam, A, B, t) AS v FROM fits").collect():
        assert np.isclose(r.v, equations.Fit(r.eq_type, r.L, r.c, r.lam, r.A, r.B).at(r.t))


def test_writes_that_count(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("k"))
    assert sinks.write_observed(df, str(tmp_path / "t"), ("k",), n=F.count(F.lit(1)), most=F.max("id"), none=F.max(F.lit(None).cast("double"))) == {"n": 100, "most": 99, "none": None}
    assert spark.read.parquet(str(tmp_path / "t")).count() == 100
    assert sinks.write_bundle({"a": df, "b": df.limit(0)}, str(tmp_path / "x")) == {"a": 100, "b": 0}
    s = spark.createDataFrame([(1, [1, 2], [3]), (2, [1, 2, 3], [3, 4, 5, 6])], "source_window_id long, history_ids array<long>, target_ids array<long>")
    want = {"n_samples": 2, "max_history": 3, "max_target_count": 4}
    assert sinks.write_samples(s, str(tmp_path / "s")) == want
    assert json.loads("".join(r.value for r in spark.read.text(str(tmp_path / "s.summary.json"), wholetext=True).collect())) == want
