"""Regime labels of series split into ranges are those of whole series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_operators import slow_runs
from tidemark.config import Regimes
from tidemark.operators import predictors
from tidemark.plans import catalog


def runs_table(spark, series, bucket):
    rows = []
    for k, v in series.items():
        for i, x in enumerate(v):
            rows.append((k, i, i // bucket, int(x), int(v[i - 1]) if i else None, int(v[i + 1]) if i + 1 < len(v) else None))
    return spark.createDataFrame(rows, "channel string, pos long, _bucket long, raw int, was int, next int").repartition(3)


@pytest.mark.parametrize("least, bucket", [(3, 7), (1, 5), (4, 1), (6, 1000)])
def test_runs_in_ranges_against_a_loop(spark, least, bucket):
    rng = np.random.default_rng(least)
    series = {f"s{k}": np.repeat(rng.integers(-1, 3, 80), rng.integers(1, 1 + k % 7 + 1, 80))[: 30 + 5 * k] for k in range(14)}
    series |= {"none": np.full(20, -1), "one": np.array([2]), "same": np.full(25, 1), "short": np.array([0, 1, -1, 2, -1, -1, 0, 1, 2, 2])}
    got = {}
    for r in predictors.smoothed_runs(runs_table(spark, series, bucket), least).collect():
        got.setdefault(r.channel, {})[r.pos] = r.label
    for k, v in series.items():
        assert [got[k][i] for i in range(len(v))] == slow_runs(v, least), k
        assert predictors.without_short_runs(np.asarray(v), least).tolist() == slow_runs(v, least)


def test_labels_at_any_range(spark, data):
    sig = catalog.sig(spark, data).filter("idx < 400").cache()
    whole = {}
    for r in sig.select("channel", "idx", "s").collect():
        whole.setdefault(r.channel, {})[r.idx] = np.nan if r.s is None else r.s
    turned = sorted(whole)[:2]
    for bucket in (26, 101, 65_536):
        got = {(r.channel, r.idx): r.label for r in predictors.labelled(sig, circular=turned, bucket=bucket).collect()}
        assert len(got) == sum(map(len, whole.values()))
        for c, v in whole.items():
            x = np.array([v[i] for i in sorted(v)])
            x = np.unwrap(x, period=360) if c in turned else x
            want = predictors.without_short_runs(predictors.best_labels(x, 24, 24, c in turned), 3)
            assert [got[c, i] for i in sorted(v)] == [predictors.PREDICTORS[k] if k >= 0 else None for k in want], (c, bucket)
    with pytest.raises(ValueError):
        predictors.labelled(sig, Regimes(), bucket=24)


def test_a_long_channel_is_many_tasks(spark):
    """No task labels more rows than a range and its history."""
    n = 60_000
    sig = spark.range(n).select(F.lit("a").alias("channel"), F.col("id").alias("idx"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10.0).alias("s"))
    raw = predictors.raw_labels(sig, bucket=8192)
    assert raw.groupBy("_bucket").count().count() == 8 and raw.count() == n
    assert predictors.labelled(sig, bucket=8192).filter("label is null").count() == 24
