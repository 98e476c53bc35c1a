"""Pattern discovery on vectors: nearest prototypes, Lloyd steps, quality, medoids, leaders.

A table of prototypes has a stated size (k vectors) and is sent to the tasks; points never leave their partitions but as
sums per cluster, or in the one ordered pass that leaders need; medoids and silhouettes follow from clusters' means and
variances, as distances between points are squared differences of vectors. Only thresholds come from a sample.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def with_prototypes(points: DataFrame, prototypes: list[tuple[int, Sequence[float]]], vector: str = "v") -> Column:
    """A sorted array of (d2, pattern_id) of a point to each prototype, the nearest (ties: smallest id) first."""
    known = F.array(*[F.struct(F.lit(int(k)).alias("id"), F.array(*[F.lit(float(x)) for x in v]).alias("p")) for k, v in prototypes])
    return F.array_sort(F.transform(known, lambda r: F.struct(F.round(squared_distance(F.col(vector), r["p"]), 9).alias("d2"), r["id"].alias("pattern_id"))))


def nearest(points: DataFrame, prototypes: DataFrame, id_col: str = "id", vector: str = "v") -> DataFrame:
    """id_col, pattern_id, distance to the nearest of prototypes (pattern_id, v). The prototypes, k by definition small, are one
    broadcast row; a point is compared with them in place, so no row is made per pair.
    """
    row = prototypes.agg(F.sort_array(F.collect_list(F.struct("pattern_id", F.col(vector).alias("p")))).alias("_all"))
    dist = F.transform("_all", lambda r: F.struct(F.round(squared_distance(F.col(vector), r["p"]), 9).alias("d2"), r["pattern_id"].alias("pattern_id")))
    out = points.join(F.broadcast(row)).withColumn("_d", F.array_sort(dist))
    second = F.when(F.size("_d") > 1, F.sqrt(F.element_at("_d", 2)["d2"]))
    return out.select(id_col, F.col("_d")[0]["pattern_id"].alias("pattern_id"), F.sqrt(F.col("_d")[0]["d2"]).alias("distance"), second.alias("second_distance"))


def lloyd_step(points: DataFrame, prototypes: DataFrame, id_col: str = "id", vector: str = "v") -> DataFrame:
    """New prototypes: pattern_id, pos, value, n. Sums per cluster and place are made before the shuffle."""
    labels = nearest(points, prototypes, id_col, vector).select(id_col, "pattern_id")
    each = points.join(labels, id_col).select("pattern_id", F.posexplode(vector).alias("pos", "x"))
    return each.groupBy("pattern_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("value"), F.count(F.lit(1)).alias("n"))


def centroids(points: DataFrame, labels: DataFrame, id_col: str = "id", vector: str = "v") -> DataFrame:
    each = points.join(labels.select(id_col, "pattern_id"), id_col).select("pattern_id", F.posexplode(vector).alias("pos", "x")).groupBy("pattern_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy("pattern_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda r: r["x"]).alias(vector))


def first_points(points: DataFrame, k: int, seed: int, id_col: str, vector: str, turn: int | None = None) -> np.ndarray:
    """k points drawn by a hash of id and seed, and of the turn where there is one."""
    drawn = [F.lit(x) for x in (seed, turn) if x is not None]
    start = points.orderBy(F.xxhash64(F.col(id_col), *drawn), id_col).select(vector).limit(k).collect()
    return np.array([[float(x) for x in r[0]] for r in start])


def kmeans_tables(points: DataFrame, candidates: Sequence[int], rounds: int = 50, seed: int = 42, id_col: str = "id", vector: str = "v") -> dict[int, np.ndarray]:
    """Prototypes by candidate k. Starts from k points drawn by a hash of id and seed; an empty cluster moves to a point drawn by a hash
    of id, seed and round.

    Each round reads the points once for all candidates whose prototypes still move, and once more to draw where clusters are
    empty; only prototypes come to the driver.
    """
    start = first_points(points, max(candidates), seed, id_col, vector)
    now = {k: start[:k] for k in candidates}
    moving = set(now) if len(start) else set()
    for turn in range(rounds):
        if not moving:
            break
        sums = cluster_sums(points, {k: now[k] for k in moving}, vector)
        empty = {k: [i for i in range(len(now[k])) if i not in sums[k]] for k in moving}
        most = max(map(len, empty.values()))
        drawn = first_points(points, most, seed, id_col, vector, turn) if most else None
        for k in sorted(moving):
            new = np.array([sums[k][i][1] if i in sums[k] else drawn[empty[k].index(i)] for i in range(len(now[k]))])
            if np.allclose(new, now[k], rtol=0, atol=1e-12):
                moving.discard(k)
            else:
                now[k] = new
    return now


def kmeans(points: DataFrame, k: int, rounds: int = 50, seed: int = 42, id_col: str = "id", vector: str = "v") -> tuple[DataFrame, DataFrame]:
    """(labels, prototypes) of one k."""
    table = as_table(points, list(enumerate(kmeans_tables(points, [k], rounds, seed, id_col, vector)[k])), vector)
    return nearest(points, table, id_col, vector), table


def quality(labels: DataFrame) -> DataFrame:
    """n_clusters, separation (the mean of (b - a) / max(a, b) with a, b the distances to the nearest and the next prototype),
    balance (smallest cluster over the mean one) and quality, their product. Input: what nearest() gives.
    """
    a, b = F.col("distance"), F.col("second_distance")
    sep = F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0))
    by = labels.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"), F.sum(sep).alias("s"))
    out = by.agg(F.count(F.lit(1)).alias("n_clusters"), (F.sum("s") / F.sum("n")).alias("separation"), (F.min("n") / F.avg("n")).alias("balance"))
    return out.withColumn("quality", F.col("separation") * F.col("balance"))


def select_k(points: DataFrame, candidates: Sequence[int], rounds: int = 10, seed: int = 42, id_col: str = "id", vector: str = "v") -> tuple[int, dict[int, float], DataFrame, DataFrame]:
    """(k, quality by k, labels, prototypes) of the best candidate; the smaller k on a tie. Points are read once into memory and disk."""
    from pyspark import StorageLevel

    kept = points.repartition(id_col).persist(StorageLevel.MEMORY_AND_DISK)  # a file of one row group is one task's rows else
    best, scores = None, {}
    for k, prototypes in kmeans_tables(kept, candidates, rounds, seed, id_col, vector).items():
        table = as_table(points, list(enumerate(prototypes)), vector)
        labels = nearest(kept, table, id_col, vector)
        scores[k] = float(quality(labels).first()["quality"] or 0.0)
        if best is None or scores[k] > scores[best[0]]:
            best = (k, labels, table)
    kept.unpersist()
    return best[0], scores, best[1], best[2]


def sample(points: DataFrame, n: int, seed: int = 42, id_col: str = "id", vector: str = "v") -> tuple[list, np.ndarray]:
    """(ids, matrix) of the n points that come first by a hash of id and seed, in the order of ids. n bounds what the driver holds."""
    rows = points.select(id_col, vector).orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(n).collect()
    rows.sort(key=lambda r: r[0])
    return [r[0] for r in rows], np.array([r[1] for r in rows], dtype=float).reshape(len(rows), -1 if rows else 0)


def pairwise(x: np.ndarray) -> np.ndarray:
    q = (x * x).sum(1)
    d = np.sqrt(np.maximum(q[:, None] + q[None, :] - 2 * x @ x.T, 0))
    np.fill_diagonal(d, 0)
    return d


def kmedoids(distances: np.ndarray, k: int, rounds: int = 50, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(labels, medoids) for a distance matrix; a medoid is the member with the least sum of distances."""
    medoids = np.sort(np.random.default_rng(seed).choice(len(distances), size=min(k, len(distances)), replace=False))
    labels = distances[:, medoids].argmin(1)
    for _ in range(rounds):
        new = medoids.copy()
        for j in range(len(medoids)):
            own = np.flatnonzero(labels == j)
            if len(own):
                new[j] = own[distances[np.ix_(own, own)].sum(1).argmin()]
        now = distances[:, new].argmin(1)
        same = (now == labels).all() and (new == medoids).all()
        medoids, labels = new, now
        if same:
            break
    return labels, medoids


def silhouette(distances: np.ndarray, labels: np.ndarray) -> float:
    """Mean of (b - a) / max(a, b), with a a point's mean distance to its own cluster, itself included, and b that to the nearest other."""
    kinds = np.unique(labels)
    if len(kinds) < 2:
        return 0.0
    means = np.stack([distances[:, labels == k].mean(1) for k in kinds], 1)
    own = np.searchsorted(kinds, labels)
    a = means[np.arange(len(labels)), own]
    means[np.arange(len(labels)), own] = np.inf
    b = means.min(1)
    top = np.maximum(a, b)
    return float(np.where(top > 0, (b - a) / np.where(top > 0, top, 1), 0).mean())


def assigned(x: np.ndarray, prototypes: np.ndarray) -> np.ndarray:
    """The nearest prototype of each row; the first on a tie."""
    return np.stack([np.round(((x - p) ** 2).sum(1), 9) for p in prototypes], 1).argmin(1)


def cluster_sums(points: DataFrame, tables: dict[int, np.ndarray], vector: str = "v") -> dict[int, dict[int, tuple[int, np.ndarray, float]]]:
    """By table of prototypes and their number: (count, mean, mean squared distance to it) of the points nearest to the prototype.
    Tasks read their points once for all tables and send a sum per cluster, which are added up by cluster.
    """
    import pandas as pd

    schema = "k int, pattern_id int, n long, s array<double>, q double"

    def sums(frames):
        total = {k: (np.zeros(len(p)), np.zeros(p.shape), np.zeros(len(p))) for k, p in tables.items()}
        for f in frames:
            if len(f):
                x = np.stack(f[vector].to_numpy()).astype(float)
                for k, (n, s, q) in total.items():
                    label = assigned(x, tables[k])
                    np.add.at(n, label, 1)
                    np.add.at(s, label, x)
                    np.add.at(q, label, (x * x).sum(1))
        for k, (n, s, q) in total.items():
            live = np.flatnonzero(n)
            if not len(live):  # a task without rows: Arrow makes no arrays of an empty list
                continue
            yield pd.DataFrame({"k": np.full(len(live), k), "pattern_id": live, "n": n[live].astype(np.int64), "s": list(s[live]), "q": q[live]})

    def added(g):
        return pd.DataFrame({"k": g["k"][:1], "pattern_id": g["pattern_id"][:1], "n": [g["n"].sum()], "s": [np.stack(g["s"].to_numpy()).sum(0)], "q": [g["q"].sum()]})

    out: dict[int, dict[int, tuple[int, np.ndarray, float]]] = {k: {} for k in tables}
    for r in points.select(vector).mapInPandas(sums, schema).groupBy("k", "pattern_id").applyInPandas(added, schema).collect():  # clusters
        mean = np.array(r["s"]) / r["n"]
        out[r["k"]][r["pattern_id"]] = (r["n"], mean, max(r["q"] / r["n"] - float(mean @ mean), 0.0))
    return out


def next_to_means(points: DataFrame, tables: dict[int, np.ndarray], means: dict[int, dict[int, np.ndarray]], id_col: str = "id", vector: str = "v") -> dict[int, dict[int, list[float]]]:
    """By table and cluster, its point that is next to the cluster's mean; the smallest id on a tie."""
    import pandas as pd

    def best(frames):
        for f in frames:
            if not len(f):
                continue
            x = np.stack(f[vector].to_numpy()).astype(float)
            for k, prototypes in tables.items():
                label = assigned(x, prototypes)
                for j in np.unique(label):
                    own = np.flatnonzero(label == j)
                    d = np.round(((x[own] - means[k][j]) ** 2).sum(1), 9)
                    first = own[np.lexsort((f[id_col].to_numpy()[own], d))[0]]
                    yield pd.DataFrame({"k": [k], "pattern_id": [j], "d": [d.min()], "id": [f[id_col].iloc[first]], "v": [x[first]]})

    rows = points.select(id_col, vector).mapInPandas(best, f"k int, pattern_id int, d double, id {points.schema[id_col].dataType.simpleString()}, v array<double>")
    out: dict[int, dict[int, list[float]]] = {k: {} for k in tables}
    for r in rows.groupBy("k", "pattern_id").agg(F.min_by("v", F.struct("d", "id")).alias("v")).collect():  # clusters
        out[r["k"]][r["pattern_id"]] = list(r["v"])
    return out


def as_table(points: DataFrame, rows: list[tuple[int, Sequence[float]]], vector: str = "v") -> DataFrame:
    return points.sparkSession.createDataFrame([(int(k), [float(x) for x in v]) for k, v in rows], f"pattern_id int, {vector} array<double>")


def medoid_tables(points: DataFrame, candidates: Sequence[int], rounds: int = 50, seed: int = 42, id_col: str = "id", vector: str = "v") -> dict[int, np.ndarray]:
    """Medoids of all points by candidate k, under squared distance: the member with the least sum of distances is the one next to
    its cluster's mean. Ties go to the smallest id; an empty cluster keeps its medoid. Starts from k points drawn by a hash. Each
    round reads the points twice for all candidates whose medoids still move.
    """
    start = first_points(points, max(candidates), seed, id_col, vector)
    now = {k: start[:k] for k in candidates}
    moving = set(now) if len(start) else set()
    for _ in range(rounds):
        if not moving:
            break
        tables = {k: now[k] for k in moving}
        means = {k: {j: m for j, (_, m, _) in t.items()} for k, t in cluster_sums(points, tables, vector).items()}
        best = next_to_means(points, tables, means, id_col, vector)
        for k in sorted(moving):
            new = np.array([best[k].get(i, v) for i, v in enumerate(now[k].tolist())])
            if np.array_equal(new, now[k]):
                moving.discard(k)
            else:
                now[k] = new
    return now


def medoids(points: DataFrame, k: int, rounds: int = 50, seed: int = 42, id_col: str = "id", vector: str = "v") -> DataFrame:
    """Medoids (pattern_id, v) of one k."""
    return as_table(points, list(enumerate(medoid_tables(points, [k], rounds, seed, id_col, vector)[k])), vector)


def silhouettes(points: DataFrame, tables: dict[int, np.ndarray], vector: str = "v") -> dict[int, float]:
    """By table of prototypes, silhouette times balance of all points, labelled by the nearest one, under squared distance.

    A point's mean distance to a cluster is that to its mean plus the cluster's variance; its own cluster counts it too.
    Fewer than two clusters score 0. Points are read twice for all tables.
    """
    found = {k: t for k, t in cluster_sums(points, {k: p for k, p in tables.items() if len(p)}, vector).items() if len(t) > 1}
    order = {k: sorted(t) for k, t in found.items()}
    means = {k: np.stack([t[j][1] for j in order[k]]) for k, t in found.items()}
    spread = {k: np.array([t[j][2] for j in order[k]]) for k, t in found.items()}

    def scores(frames):
        import pandas as pd

        for f in frames:
            if len(f):
                x = np.stack(f[vector].to_numpy()).astype(float)
                for k in order:
                    own = np.searchsorted(order[k], assigned(x, tables[k]))
                    d = np.stack([((x - m) ** 2).sum(1) for m in means[k]], 1) + spread[k]
                    a = d[np.arange(len(x)), own].copy()
                    d[np.arange(len(x)), own] = np.inf
                    b = d.min(1)
                    yield pd.DataFrame({"k": [k], "s": [((b - a) / np.maximum(np.maximum(a, b), 1e-9)).sum()], "n": [len(x)]})

    out = dict.fromkeys(tables, 0.0)
    if found:
        for r in points.select(vector).mapInPandas(scores, "k int, s double, n long").groupBy("k").agg((F.sum("s") / F.sum("n")).alias("s")).collect():
            sizes = [n for n, _, _ in found[r["k"]].values()]
            out[r["k"]] = float(r["s"]) * min(sizes) / sum(sizes) * len(tables[r["k"]])
    return out


def silhouette_of(points: DataFrame, table: DataFrame, vector: str = "v") -> float:
    """The score of one table (pattern_id, v)."""
    return silhouettes(points, {0: np.array([r[vector] for r in table.orderBy("pattern_id").collect()])}, vector)[0]  # k rows


def select_medoids(points: DataFrame, candidates: Sequence[int] = range(8, 33, 4), rounds: int = 50, seed: int = 42, id_col: str = "id", vector: str = "v") -> tuple[DataFrame, dict[int, float]]:
    """(medoids, score by k) of the best candidate; the first on a tie."""
    from pyspark import StorageLevel

    kept = points.select(id_col, vector).persist(StorageLevel.MEMORY_AND_DISK)
    n = kept.count()
    candidates = list(dict.fromkeys(min(k, n) for k in candidates if n))
    tables = medoid_tables(kept, candidates, rounds, seed, id_col, vector) if candidates else {}
    scores = silhouettes(kept, tables, vector)
    kept.unpersist()
    best = tables[max(candidates, key=scores.__getitem__)] if candidates else []
    return as_table(points, list(enumerate(best)), vector), scores


class Leaders:
    """Rows taken in order: a row joins the nearest mean within the threshold (give or take rounding, as thresholds are often distances
    themselves) and moves it, or founds a cluster.

    Means are passed over by the triangle inequality: a row's distance to a mean is at least the difference of their distances to
    any pivot, the founders of the first clusters. Only means that this leaves within the threshold are compared in full, so results
    are those of comparing all.
    """

    PIVOTS = 12

    def __init__(self, threshold: float, size: int):
        self.threshold, self.n = threshold * (1 + 1e-9), 0
        self.means, self.counts, self.to_pivots, self.pivots = np.empty((16, size)), np.zeros(16, np.int64), np.empty((16, self.PIVOTS)), np.empty((0, size))
        self.compared = 0

    def add(self, row: np.ndarray) -> int:
        own = np.sqrt(((self.pivots - row) ** 2).sum(1))
        if self.n:
            k = len(self.pivots)
            least = np.abs(self.to_pivots[: self.n, :k] - own).max(1)
            near = np.flatnonzero(least <= self.threshold * (1 + 1e-9) + 1e-9 * (1 + own.max()))
            self.compared += len(near)
            if len(near):
                off = self.means[near] - row
                d = np.einsum("ij,ij->i", off, off)
                best = int(d.argmin())
                if d[best] <= self.threshold * self.threshold:
                    j = int(near[best])
                    self.counts[j] += 1
                    self.means[j] += (row - self.means[j]) / self.counts[j]
                    self.to_pivots[j, :k] = np.sqrt(((self.pivots - self.means[j]) ** 2).sum(1))
                    return j
        if self.n == len(self.means):
            self.means, self.counts, self.to_pivots = (np.concatenate([x, np.zeros_like(x)]) for x in (self.means, self.counts, self.to_pivots))
        self.means[self.n], self.counts[self.n] = row, 1
        self.n += 1
        if len(self.pivots) < self.PIVOTS:
            self.pivots = np.concatenate([self.pivots, row[None]])
            at = len(self.pivots)
            self.to_pivots[: self.n, at - 1] = np.sqrt(((self.means[: self.n] - row) ** 2).sum(1))
            own = np.append(own, 0.0)
        self.to_pivots[self.n - 1, : len(own)] = own
        return self.n - 1


def ordered_leaders(points: DataFrame, thresholds: Sequence[float], id_col: str = "id", vector: str = "v", order: str | None = None) -> DataFrame:
    """k (the threshold's number), id_col, label, v of every point, and for each leader a row with n, its points, and its mean as v.

    Every point depends on all before it, so the points of one threshold pass through one task in the order (ties: of ids). They
    stream: the task holds the leaders, not the points. This is the limit of the method: more machines don't shorten a pass, and
    the leaders of one threshold must fit in one task.
    """
    import pandas as pd

    def run(frames):
        now, at = None, None
        for f in frames:
            for k, g in f.groupby("k", sort=True):
                x = np.stack(g["v"].to_numpy()).astype(float)
                if k != at:
                    if now is not None:
                        yield ended(at, now)
                    now, at = Leaders(thresholds[k], x.shape[1]), k
                yield pd.DataFrame({"k": k, "id": g["id"], "label": [now.add(row) for row in x], "n": None, "v": g["v"]})
        if now is not None:
            yield ended(at, now)

    def ended(k, now):
        return pd.DataFrame({"k": k, "id": None, "label": range(now.n), "n": now.counts[: now.n], "v": list(now.means[: now.n])})

    kind = points.schema[id_col].dataType.simpleString()
    rows = points.select(F.explode(F.array(*[F.lit(i) for i in range(len(thresholds))])).alias("k"), F.col(id_col).alias("id"), F.col(order or id_col).alias("_o"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.repartition(len(thresholds), "k").sortWithinPartitions("k", "_o", "id").select("k", "id", "v")
    return rows.mapInPandas(run, f"k int, id {kind}, label long, n long, v array<double>")


def merged_down(labels: np.ndarray, sizes: np.ndarray, means: np.ndarray, upper: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(new label of each, sizes, means) after the smallest cluster has joined the one nearest to it until ``upper`` are left."""
    to, alive = np.arange(len(labels)), np.arange(len(labels))
    sizes, means = sizes.astype(float).copy(), means.astype(float).copy()
    while len(alive) > upper:
        i = int(sizes[alive].argmin())
        gap = np.linalg.norm(means[alive] - means[alive[i]], axis=1)
        gap[i] = np.inf
        source, target = alive[i], alive[int(gap.argmin())]
        means[target] = (means[target] * sizes[target] + means[source] * sizes[source]) / (sizes[target] + sizes[source])
        sizes[target] += sizes[source]
        to[to == source] = target
        alive = np.delete(alive, i)
    return np.searchsorted(alive, to), sizes[alive], means[alive]


def leader_clusters(points: DataFrame, shares: Sequence[float] = (0.1, 0.15, 0.2, 0.25, 0.3), least: int = 24, lower: int = 12, upper: int = 96, sample_size: int = 2048, seed: int = 42, id_col: str = "id", vector: str = "v", order: str | None = None) -> tuple[DataFrame, DataFrame, dict[float, float]]:
    """(labels, prototypes, score by threshold): leader clustering of all points in the order (default: of ids) at several thresholds,
    the best kept; labels has id_col and pattern_id, prototypes pattern_id and the mean of its points. Partitions don't matter.

    Thresholds are quantiles of nearest-neighbour distances in a sample of ``sample_size``. Points of clusters smaller than ``least``
    go each to the nearest larger one, if there is one; then the smallest cluster joins its nearest until ``upper`` (fewer for few
    points) are left; the score is separation over mean distance, times balance and a penalty for counts outside lower..upper.
    """
    import pandas as pd

    from tidemark.sources.sinks import fresh_path, write_table

    spark = points.sparkSession
    _, x = sample(points, sample_size, seed, id_col, vector)
    n_points = points.count()
    none = points.select(id_col, F.lit(0).alias("pattern_id")).limit(0)
    if not len(x):
        return none, as_table(points, [], vector), {}
    upper = max(2, min(upper, max(2, n_points // max(least, 1))))
    lower = min(max(2, lower), upper)
    d = pairwise(x)
    np.fill_diagonal(d, np.inf)
    near = d.min(1) if len(x) > 1 else np.zeros(1)
    thresholds = sorted({float(np.quantile(near, q)) for q in shares})
    path = fresh_path(spark)
    write_table(ordered_leaders(points, thresholds, id_col, vector, order), path)  # the ordered passes are made once
    found = spark.read.parquet(path)
    rows = found.filter(F.col("n") >= least).select("k", "label", "v").orderBy("k", "label").collect()  # a least-th of the points at most
    large = {k: (np.array([r["label"] for r in rows if r["k"] == k]), np.array([r["v"] for r in rows if r["k"] == k], float)) for k in range(len(thresholds))}

    def moved(frames):
        for f in frames:
            for k, g in f.groupby("k"):
                labels, means = large[k]
                now = g["label"].to_numpy().copy()
                small = np.flatnonzero(~np.isin(now, labels)) if len(labels) else []
                for i in small:
                    now[i] = labels[((means - np.asarray(g["v"].iloc[i], float)) ** 2).sum(1).argmin()]
                yield g.assign(label=now)

    kind = points.schema[id_col].dataType.simpleString()
    rows = found.filter("n is null").select("k", "id", "label", "v").mapInPandas(moved, f"k int, id {kind}, label long, v array<double>")

    def sums(frames):
        for f in frames:
            out = [(k, j, len(g), np.stack(g["v"].to_numpy()).astype(float).sum(0)) for (k, j), g in f.groupby(["k", "label"])]
            yield pd.DataFrame(out, columns=["k", "label", "n", "s"])

    def merged(g):
        g = g.sort_values("label")
        new, _, means = merged_down(g["label"].to_numpy(), g["n"].to_numpy(), np.stack(g["s"].to_numpy()) / g["n"].to_numpy()[:, None], upper)
        return pd.DataFrame({"k": g["k"].to_numpy(), "label": g["label"].to_numpy(), "pattern_id": new, "mean": [means[i] for i in new]})

    each = rows.mapInPandas(sums, "k int, label long, n long, s array<double>").select("k", "label", "n", F.posexplode("s").alias("pos", "s"))
    each = each.groupBy("k", "label", "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    clusters = each.groupBy("k", "label").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda r: r["s"]).alias("s"))
    last = fresh_path(spark)
    write_table(clusters.groupBy("k").applyInPandas(merged, "k int, label long, pattern_id int, mean array<double>"), last)
    where = spark.read.parquet(last)
    placed = rows.join(where, ["k", "label"])
    by = placed.groupBy("k", "pattern_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.sqrt(squared_distance(F.col("v"), F.col("mean")))).alias("d"), F.first("mean").alias("mean")).collect()  # upper rows a threshold
    scores: dict[float, float] = {}
    best = None
    for k, t in enumerate(thresholds):
        mine = sorted((r for r in by if r["k"] == k), key=lambda r: r["pattern_id"])
        size, score = np.array([r["n"] for r in mine], float), -np.inf
        if len(mine) > 1:
            gap = pairwise(np.array([r["mean"] for r in mine]))
            np.fill_diagonal(gap, np.inf)
            penalty = min(1.0, len(mine) / lower) * min(1.0, upper / len(mine))
            score = gap.min(1).mean() / max(sum(r["d"] for r in mine) / size.sum(), 1e-6) * (0.5 + 0.5 * size.min() / size.mean()) * penalty
        scores[t] = float(score)
        if best is None or score > best[0] + 1e-9 * abs(best[0]) or best[0] == -np.inf < score:  # the first of equal ones, rounding aside
            best = (score, k, as_table(points, [(r["pattern_id"], r["mean"]) for r in mine], vector))
    labels = placed.filter(F.col("k") == best[1]).select(F.col("id").alias(id_col), "pattern_id")
    return labels, best[2], scores
