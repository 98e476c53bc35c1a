"""Two series side by side give what each gives alone, though their windows, steps and pieces have the same numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import Config, Regimes, Windows
from tidemark.operators import events, pairs, predictors, samples, segments, signal, windows
from tidemark.plans import pipeline

ALL = ("series_id", "channel")


@pytest.fixture(scope="module")
def grid(spark):
    rng = np.random.default_rng(0)
    rows = [(s, c, i, None if rng.random() < 0.03 else float(x)) for s, n in (("p", 96), ("q", 78)) for c in "ab" for i, x in enumerate(np.cumsum(rng.normal(size=n)))]
    df = spark.createDataFrame(rows, "series_id string, channel string, idx long, x double")
    return df.withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(idx as int))")).cache()


def window_table(g):
    keys = signal.series_keys(g)
    w = windows.starts(g.select(*keys, "idx").distinct().withColumn("one", F.lit(0)), 24, 1, (*keys, "one"))
    return w.select(*keys, "window_id", F.col("idx").alias("start_idx"), (F.col("idx") + 23).alias("end_idx"), F.floor(F.col("idx") / 60).alias("block_id"))


def smooth(g):
    return signal.signal(g, keys=(*signal.series_keys(g), "channel"))


def sampled(g):
    w = window_table(g)
    return samples.samples(w, w.select(*signal.series_keys(w), "window_id", F.col("block_id").alias("pattern_id")), count=6, same_block=True)


def regimes(g):
    keys = (*signal.series_keys(g), "channel")
    return predictors.windows_in_blocks(predictors.regimes(predictors.labelled(smooth(g), keys=keys), Regimes(min_changed=1), keys), 6)


def refit(g):
    keys = (*signal.series_keys(g), "channel")
    s = g.filter("x is not null")
    return segments.joint_refit(samples.boundary_union(segments.segmented(s, 3.0, harmonic=False, keys=keys)), s)


def dynamics(g):
    keys = (*signal.series_keys(g), "channel")
    s = smooth(g)
    pieces = segments.dynamics_fits(s, segments.dynamics_boundaries(s, keys=keys))
    return pipeline.segments_as_windows(pieces, s).select(*keys[:-1], "window_id", "start_idx", "end_idx", F.map_entries("channel_stds").cast("string").alias("std"), F.map_entries("channel_x0").cast("string").alias("x0"))


def time_block(g):
    keys = (*signal.series_keys(g), "channel")
    s = smooth(g)
    return windows.time_block(windows.event_bridge(events.extrema(s, keys), 78), windows.event_bridge(events.peaks(s, keys), 78))


def ranged(g):
    r = window_table(g).filter("window_id % 40 = 0").select(*signal.series_keys(g), F.col("window_id").alias("range_id"), "start_idx", "end_idx")
    return windows.ranges_bridge(g.select(*signal.series_keys(g), "channel", "idx"), r)


CASES = {
    "history_frames": lambda g: samples.history_frames(window_table(g)),
    "targets_at_offsets": lambda g: samples.targets_at_offsets(window_table(g), count=5),
    "targets_by_time": lambda g: samples.targets_by_time(window_table(g)),
    "samples": sampled,
    "chronological_split": lambda g: samples.chronological_split(window_table(g), "start_idx"),
    "boundary_union": lambda g: samples.boundary_union(window_table(g), window_table(g).filter("window_id < 9")),
    "windows_in_blocks": regimes,
    "joint_refit": refit,
    "dynamics": dynamics,
    "time_block": time_block,
    "ranges_bridge": ranged,
    "synchronous": lambda g: pairs.synchronous(smooth(g), 78),
    "feature_vectors": lambda g: pipeline.feature_vectors(windows.intra_features(smooth(g), keys=(*signal.series_keys(g), "channel")), ["a", "b"]),
    "sequence_samples": lambda g: pipeline.sequence_samples(p := pipeline.prepare(g, ["a", "b"], Config(windows=Windows(horizon=12)), compound=("a", "b")), p.vectors.select(*signal.series_keys(g), "window_id", F.floor(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("pattern_id")), Config(windows=Windows(horizon=12))),
}


def rows(collected, names):
    cell = lambda x: [cell(y) for y in x] if isinstance(x, list) else round(x, 7) + 0.0 if isinstance(x, float) else x
    return sorted(str([cell(r[c]) for c in names]) for r in collected)


@pytest.mark.parametrize("name", CASES)
def test_each_series_as_if_alone(grid, name):
    both = CASES[name](grid)
    every = both.collect()
    for s in "q" if name == "sequence_samples" else "pq":
        alone = CASES[name](grid.filter(F.col("series_id") == s).drop("series_id"))
        names = [c for c in both.columns if c != "series_id"]
        assert sorted(names) == sorted(alone.columns)
        want = rows(alone.collect(), names)
        assert want and rows([r for r in every if r["series_id"] == s], names) == want


def test_samples_of_two_equal_series(spark):
    """One series of 60 windows has 28 samples of 24 targets; two have 56."""
    one = spark.range(60).select(F.col("id").alias("window_id"), F.col("id").alias("start_idx"))
    alone = samples.samples(one, count=6).count()
    assert alone == 28
    two = one.crossJoin(spark.createDataFrame([("p",), ("q",)], "series_id string"))
    assert samples.samples(two, count=6).count() == 56


def test_backtest_has_the_errors_of_both_series(grid):
    def tested(g):
        keys = (*signal.series_keys(g), "channel")
        s = smooth(g)
        out = pipeline.backtest(pipeline.feature_vectors(windows.intra_features(s, keys=keys), ["a", "b"]), s, horizons=2)
        return {(r["split"], r.channel, r.horizon): (r.n, r.mae) for r in out.collect()}

    p, q = (tested(grid.filter(F.col("series_id") == s).drop("series_id")) for s in "pq")
    both = tested(grid)
    assert both.keys() == p.keys() | q.keys()
    for k, (n, mae) in both.items():
        (n1, m1), (n2, m2) = p[k], q[k]
        assert n == n1 + n2 and np.isclose(mae, (n1 * m1 + n2 * m2) / n)


def test_rows_without_an_order_have_no_place(spark):
    df = spark.createDataFrame([(0,), (None,), (5,)], "start_idx long")
    assert sorted((r.start_idx, r.pos) for r in samples.numbered(df).collect()) == [(0, 0), (5, 1)]
