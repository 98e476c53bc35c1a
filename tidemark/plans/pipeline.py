"""From observations to forecasts as tables: prepare, discover, sample, backtest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.operators import clustering, events, metrics, pairs, samples, signal, windows


@dataclass(frozen=True)
class Prepared:
    signal: DataFrame
    extrema: DataFrame
    peaks: DataFrame
    intra: DataFrame
    inter: DataFrame
    hazard: DataFrame
    vectors: DataFrame  # the series, window_id, v

    def tables(self) -> dict[str, DataFrame]:
        return dict(vars(self))


def prepare(grid: DataFrame, channels: list[str], config: Config = Config(), compound: tuple[str, str] | None = ("wind_speed", "rainfall")) -> Prepared:
    """All features of all windows, in long tables, and one vector per window: intra, inter and hazard features in the order of channels."""
    w = config.windows
    keys = (*signal.series_keys(grid), *signal.KEYS)
    sig = signal.signal(grid, width=config.smooth, keys=keys)
    both = compound if compound and set(compound) <= set(channels) else None
    intra = windows.intra_features(sig, w.length, w.stride, keys)
    inter = pairs.correlations(pairs.pairs_of(sig, channels), w.length, w.stride, w.max_lag)
    hazard = windows.hazard_features(sig, windows.thresholds(grid, config.upper, config.lower, keys), both, w.length, w.stride, keys)
    return Prepared(sig, events.extrema(sig, keys), events.peaks(sig, keys), intra, inter, hazard, window_vectors(intra, inter, hazard, channels))


def window_vectors(intra: DataFrame, inter: DataFrame, hazard: DataFrame, channels: list[str]) -> DataFrame:
    """window_id (and the series), v: features by row, channels within, the pairs' block between the channels' two."""
    keys = signal.series_keys(intra, inter, hazard)
    order = F.array(*[F.lit(c) for c in channels])

    def block(df: DataFrame, names: tuple[str, ...], place, k: int) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), place.alias("j"), F.col(n).alias("x")) for i, n in enumerate(names)]))
        return df.select(*keys, "window_id", each.alias("c"))

    here = F.array_position(order, F.col("channel"))
    pair = F.array_position(order, F.col("a_ch")) * 1000 + F.array_position(order, F.col("b_ch"))
    parts = block(intra, windows.INTRA, here, 0).unionByName(block(inter, ("correlation", "lag_correlation", "slope_ratio"), pair, 1)).unionByName(block(hazard, windows.HAZARD, here, 2))
    return parts.groupBy(*keys, "window_id").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["x"]).alias("v"))


def discover(prepared: Prepared, least: int = 24, sample_size: int = 2048) -> tuple[DataFrame, DataFrame]:
    """(labels, prototypes): robustly scaled vectors of all windows, leader clustering in the order of windows."""
    keys = signal.series_keys(prepared.vectors)
    scales = metrics.robust_scales(prepared.vectors, "v").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "center", "scale"))), lambda r: F.struct(r["center"].alias("c"), r["scale"].alias("s"))).alias("_s"))
    scaled = prepared.vectors.join(F.broadcast(scales)).select(F.struct("window_id", *keys).alias("id"), F.zip_with("v", "_s", lambda x, s: (x - s["c"]) / s["s"]).alias("v"))
    labels, prototypes, _ = clustering.leader_clusters(scaled, least=least, sample_size=sample_size)
    return labels.select("id.*", "pattern_id"), prototypes


def sequence_samples(prepared: Prepared, labels: DataFrame, config: Config = Config()) -> DataFrame:
    w = config.windows
    starts = prepared.intra.select(*signal.series_keys(prepared.intra), "window_id").distinct().withColumn("start_idx", F.col("window_id") * w.stride)
    return samples.samples(starts, labels, w.horizon, w.stride, w.history, samples.target_count("extrema", w.horizon, w.stride))


def ridge_forecast(vectors: DataFrame, targets: DataFrame, penalty: float = 1.0) -> tuple[list[float], float]:
    """(weights, intercept) of a ridge regression of a target on window vectors. The normal equations are sums over all rows,
    of the size of the vector squared; only they reach the driver.
    """
    import numpy as np

    rows = vectors.join(targets, "window_id").select("v", F.col("y").cast("double").alias("y"))

    def sums(frames):
        import pandas as pd

        total = None
        for f in frames:
            if len(f):
                x = np.column_stack([np.stack(f["v"].to_numpy()), np.ones(len(f)), f["y"].to_numpy()])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "x": total.ravel()})

    got = rows.mapInPandas(sums, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    if got.empty:
        return [], 0.0
    n = int(got["i"].max()) + 1
    g = np.zeros((n, n))
    g[got["i"], got["j"]] = got["x"]
    a = g[:-1, :-1] + penalty * np.diag([1.0] * (n - 2) + [0.0])
    w = np.linalg.solve(a, g[:-1, -1])
    return w[:-1].tolist(), float(w[-1])


def feature_vectors(intra: DataFrame, channels: list[str]) -> DataFrame:
    """window_id (and the series), v: the intra features of all channels, by channel."""
    keys = signal.series_keys(intra)
    own = F.struct("channel", F.array(*[F.col(n).cast("double") for n in windows.INTRA]).alias("f"))
    by = intra.filter(F.col("channel").isin(*channels)).groupBy(*keys, "window_id").agg(F.array_sort(F.collect_list(own)).alias("c"))
    return by.select(*keys, "window_id", F.flatten(F.transform("c", lambda c: c["f"])).alias("v"))


def ridge_fits(rows: DataFrame, keys: tuple[str, ...], penalty: float = 1.0) -> DataFrame:
    """keys, w, b: a ridge regression of y on v for each key. Normal equations are summed up in tasks and by key, and solved
    where their sums meet; their size is the vector's squared.
    """
    import numpy as np
    import pandas as pd

    def sums(frames):
        total: dict[tuple, np.ndarray] = {}
        for f in frames:
            for k, g in f.groupby(list(keys)):
                x = np.column_stack([np.stack(g["v"].to_numpy()), np.ones(len(g)), g["y"].to_numpy()])
                total[k] = total.get(k, 0) + x.T @ x
        if total:
            yield pd.DataFrame([(*k, g.ravel().tolist()) for k, g in total.items()], columns=[*keys, "g"])

    def solved(g: pd.DataFrame) -> pd.DataFrame:
        a = np.sum(np.stack(g["g"].to_numpy()), axis=0)
        n = int(round(len(a) ** 0.5))
        a = a.reshape(n, n)
        w = np.linalg.solve(a[:-1, :-1] + penalty * np.diag([1.0] * (n - 2) + [0.0]), a[:-1, -1])
        return pd.DataFrame([(*[g[k].iloc[0] for k in keys], w[:-1].tolist(), float(w[-1]))], columns=[*keys, "w", "b"])

    key_types = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.select(*keys).schema)
    parts = rows.select(*keys, "v", F.col("y").cast("double").alias("y")).mapInPandas(sums, key_types + "g array<double>")
    return parts.groupBy(*keys).applyInPandas(solved, key_types + "w array<double>, b double")


def backtest(vectors: DataFrame, series: DataFrame, length: int = 24, horizons: int = 24, penalty: float = 1.0, value: str = "s") -> DataFrame:
    """split, channel, horizon (null: all) and errors of ridge forecasts and of the last value on validation and test windows. Each series
    has its own split and fits; errors are over all series.

    A window's forecasts are made at its last step; windows are split in order, and those whose targets reach past the training
    windows aren't fitted on.
    """
    side = list(signal.series_keys(vectors, series))
    own = [*side, "window_id"]
    placed = samples.chronological_split(vectors.select(*own), "window_id").select(*own, "split", (F.col("window_id") + length - 1).alias("idx"))
    last = placed.filter("split = 'train'").groupBy(*side).agg(F.max("idx").alias("_last"))
    known = series.filter(F.col(value).isNotNull()).select(*side, "channel", F.col("idx").alias("at"), F.col(value).alias("y"))
    ask = placed.withColumn("horizon", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(horizons).cast("long")))).withColumn("at", F.col("idx") + F.col("horizon"))
    train = ask.filter("split = 'train'")
    train = (train.join(last, side) if side else train.join(F.broadcast(last))).filter("at <= _last").join(known, [*side, "at"]).join(vectors, own)
    fits = ridge_fits(train.select(*side, "channel", "horizon", "v", "y"), (*side, "channel", "horizon"), penalty)
    later = ask.filter("split <> 'train'").join(vectors, own).join(fits, [*side, "horizon"])  # of a series, a row a channel and horizon
    made = later.select("split", *side, "channel", "idx", "horizon", (F.aggregate(F.zip_with("v", "w", lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x) + F.col("b")).alias("prediction"))
    joined = metrics.with_actual(made, series, value)
    out = None
    for name in ("validation", "test"):
        part = metrics.errors(joined.filter(F.col("split") == name)).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def save_fits(fits: DataFrame, path: str) -> None:
    """Weights as a table; load_fits reads them back."""
    fits.write.mode("overwrite").parquet(path)


def load_fits(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).select("channel", "horizon", "w", "b")


def segments_as_windows(pieces: DataFrame, series: DataFrame, value: str = "s") -> DataFrame:
    """Pieces of joint dynamics as pattern windows: window_id, start_idx, end_idx, and by channel the deviations and starts as maps."""
    side = signal.series_keys(pieces, series)
    starts = series.select(*side, "channel", F.col("idx").alias("start_idx"), F.col(value).alias("x0"))
    both = pieces.select(*side, "segment_id", "start_idx", "end_idx", "channel", "std").join(starts, [*side, "channel", "start_idx"], "left")
    entries = F.array_sort(F.collect_list(F.struct("channel", F.coalesce("std", F.lit(0.0)).alias("std"), F.coalesce("x0", F.lit(0.0)).alias("x0"))))
    out = both.groupBy(*side, F.col("segment_id").alias("window_id"), "start_idx", "end_idx").agg(entries.alias("e"))
    maps = [F.map_from_arrays(F.col("e")["channel"], F.col("e")[k]).alias(n) for k, n in (("std", "channel_stds"), ("x0", "channel_x0"))]
    return out.select(*side, "window_id", "start_idx", "end_idx", *maps)


def discover_patterns(points: DataFrame, strategy: str = "structural", segmentation: str = "extrema") -> tuple[DataFrame, DataFrame]:
    """(labels, prototypes) of points (id, v) by strategy: structural (leaders), kmeans or kmedoids; dynamics always take medoids."""
    if segmentation == "new_physics":
        strategy = "kmedoids"
    if strategy == "structural":
        labels, table, _ = clustering.leader_clusters(points)
        return labels, table
    if strategy == "kmeans":
        table = clustering.select_k(points, range(8, 33, 4), rounds=50)[3]
    elif strategy == "kmedoids":
        table, _ = clustering.select_medoids(points)
    else:
        raise ValueError(f"unknown discovery strategy: {strategy}")
    return clustering.nearest(points, table).select("id", "pattern_id"), table
