"""k-means: the query's candidates and rounds, and what select_k gives against loops."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import clustering
from tidemark.plans import catalog


def test_candidates_and_rounds(spark, monkeypatch):
    points = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(40)], "id long, v array<double>")
    seen = []
    monkeypatch.setattr(catalog, "vectors", lambda spark, d: points)
    monkeypatch.setattr(clustering, "kmeans_tables", lambda p, candidates, rounds, *rest: seen.append((list(candidates), rounds)) or {k: np.array([[float(i), 0.0] for i in range(k)]) for k in candidates})
    catalog.kmeans_clusters(spark, "")
    assert seen == [(list(range(8, 33, 4)), 50)]


def plain_kmeans(points, x, k, rounds, seed):
    """Lloyd's rounds over all points; ids are the places of x."""
    draw = lambda n, *turn: [r.id for r in points.orderBy(F.xxhash64(F.col("id"), *[F.lit(t) for t in (seed, *turn)]), "id").limit(n).collect()]
    now = x[draw(k)].copy()
    for turn in range(rounds):
        labels = np.round(((x[:, None] - now[None]) ** 2).sum(2), 9).argmin(1)
        empty = [j for j in range(k) if not (labels == j).any()]
        fresh = x[draw(len(empty), turn)] if empty else []
        new = np.array([fresh[empty.index(j)] if j in empty else x[labels == j].mean(0) for j in range(k)])
        if np.allclose(new, now, rtol=0, atol=1e-12):
            break
        now = new
    return now


def test_select_k_against_loops(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 0.7, size=(25, 3)) for m in (0, 4, 8, 12)])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    k, scores, labels, table = clustering.select_k(points, (2, 3, 4, 6), rounds=20)
    want = {}
    for n in (2, 3, 4, 6):
        p = plain_kmeans(points, x, n, 20, 42)
        d = np.sort(np.sqrt(((x[:, None] - p[None]) ** 2).sum(2)), axis=1)
        size = np.bincount(np.sqrt(((x[:, None] - p[None]) ** 2).sum(2)).argmin(1))
        size = size[size > 0]
        want[n] = np.mean((d[:, 1] - d[:, 0]) / np.maximum(d[:, 1], d[:, 0])) * size.min() / size.mean()
    assert np.allclose([scores[n] for n in want], list(want.values()))
    assert k == max(want, key=want.get)
    p = plain_kmeans(points, x, k, 20, 42)
    assert np.allclose(np.array([r.v for r in table.orderBy("pattern_id").collect()]), p)
    assert {r.id: r.pattern_id for r in labels.collect()} == dict(enumerate(((x[:, None] - p[None]) ** 2).sum(2).argmin(1)))


def test_empty_clusters_are_drawn_anew(spark, monkeypatch):
    """Two of the start's prototypes are one point, so a cluster starts empty; the result has k clusters with points."""
    x = np.array([[float(g * 10 + i % 5 / 10), float(i // 5) / 10] for g in range(3) for i in range(20)])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    first = clustering.first_points
    monkeypatch.setattr(clustering, "first_points", lambda p, k, seed, i, v, turn=None: np.array([x[0]] * k) if turn is None else first(p, k, seed, i, v, turn))
    found = clustering.kmeans_tables(points, [3, 5], rounds=30)
    for k, p in found.items():
        labels = ((x[:, None] - p[None]) ** 2).sum(2).argmin(1)
        assert len(p) == k and len(set(labels)) == k


def test_tasks_without_rows(spark):
    """A Parquet file of one row group that is read by several tasks leaves most of them without rows."""
    rows = [(i, [float(i // 10 * 5), float(i % 10)]) for i in range(40)]
    sc, schema = spark.sparkContext, "id long, v array<double>"
    points = spark.createDataFrame(sc.parallelize(rows, 2).union(sc.parallelize([], 2)), schema)
    assert 0 in points.rdd.glom().map(len).collect()
    k, scores, labels, _ = clustering.select_k(points, (2, 4), rounds=20)
    want = clustering.select_k(spark.createDataFrame(rows, schema).coalesce(1), (2, 4), rounds=20)
    assert k == want[0] and np.allclose([scores[n] for n in (2, 4)], [want[1][n] for n in (2, 4)])
    assert {r.id: r.pattern_id for r in labels.collect()} == {r.id: r.pattern_id for r in want[2].collect()}
