"""Exact quantiles against percentile(), and what is ordered for them."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import metrics, quantiles

PROBS = [0.0, 0.25, 0.5, 0.9, 1.0]


def test_against_percentile_with_few_rows_ordered(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=3000), np.full(900, 0.5), rng.integers(0, 4, 3000), [np.nan, np.inf, -0.0]])
    rows = [(int(k), None if i % 50 == 7 else float(v)) for k in range(3) for i, v in enumerate(rng.permutation(x)[: 6000 - 2999 * k])]
    df = spark.createDataFrame([*rows, (9, None)], "key int, x double").repartition(5)
    want = {r.key: r.q for r in df.groupBy("key").agg(F.percentile("x", F.array(*map(F.lit, PROBS))).alias("q")).collect() if r.q is not None}
    for few in (quantiles.FEW, 100):
        monkeypatch.setattr(quantiles, "FEW", few)
        got = {r.key: r.q for r in quantiles.exact_quantiles(df, PROBS).collect()}
        assert got.keys() == want.keys()
        assert all(np.array_equal(got[k], want[k], equal_nan=True) for k in want)
    assert quantiles.exact_quantiles(df.filter("x is null"), PROBS).count() == 0


def test_scales_gather_no_column_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 500)
    df = spark.range(20000).select((F.col("id") - 10000).cast("double").alias("a"), (F.hash("id") / 7).alias("b"), F.lit(0.0).alias("c"))
    out = metrics.column_scales(df, ["a", "b", "c"])
    want = df.agg(*[F.coalesce(F.percentile(F.when(F.abs(F.col(c)) > 1e-6, F.abs(F.col(c))), F.lit(0.9)), F.lit(1.0)).alias(c) for c in df.columns])
    assert out.collect() == want.collect()
    assert "percentile(" not in out._jdf.queryExecution().optimizedPlan().toString()
