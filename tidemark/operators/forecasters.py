"""Forecasting sequences of window vectors: samples as blocks of tensors, and models with one contract.

Samples become rows of fixed-shape float32 blocks, so that a task reads arrays and no objects. A model is fitted by sums of gradients
over tasks: each step reads the blocks of its batch, adds up in the tasks, then in a few groups, and the driver moves the parameters, whose
number is the model's and doesn't grow with the data. Forecasts are made where the blocks are.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.samples import numbered
from tidemark.operators.signal import series_keys

BLOCK = "block long, n int, ids binary, history binary, target binary"
#: Groups in which the sums of all tasks are added up before the driver adds these.
GROUPS = 16


@dataclass(frozen=True)
class Shape:
    """Windows of a history, windows of a target, and entries of a window's vector."""

    history: int
    target: int
    size: int


def sample_vectors(samples: DataFrame, vectors: DataFrame) -> DataFrame:
    """source_window_id (and the series) with history and target, the vectors of its windows in order; vectors has window_id and v."""
    keys = series_keys(samples, vectors)
    own = [*keys, "source_window_id"]
    out = samples.select(*own)
    for name in ("history", "target"):
        each = samples.select(*own, F.posexplode(f"{name}_ids").alias("k", "window_id")).join(vectors.select(*keys, "window_id", F.col("v").cast("array<double>").alias("v")), [*keys, "window_id"])
        each = each.groupBy(*own).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda r: r["v"]).alias(name))
        out = out.join(each, own)
    return out


def checked(samples: DataFrame, shape: Shape) -> int:
    """The number of samples; an error if one isn't of the shape or has no number somewhere."""
    missing = lambda v: F.exists(v, lambda x: x.isNull() | F.isnan(x))
    odd = lambda v: F.coalesce((F.size(v) != shape.size) | missing(v), F.lit(True))
    bad = lambda c, n: F.coalesce((F.size(c) != n) | F.exists(c, odd), F.lit(True))
    got = samples.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad("history", shape.history)).alias("history"), F.count_if(bad("target", shape.target)).alias("target")).first()
    if got["history"] or got["target"]:
        raise ValueError(f"{got['history']} histories and {got['target']} targets of {got['n']} samples aren't of {shape}")
    return got["n"]


def tensor_blocks(samples: DataFrame, shape: Shape, path: str, rows: int = 256, id_col: str = "source_window_id") -> DataFrame:
    """Write samples (id_col, history, target; vectors as arrays) as BLOCK rows of ``rows`` samples each, in the order of ids, and read
    them back. The first pass checks the shapes, the second writes each sample at its place.
    """
    checked(samples, shape)
    placed = numbered(samples, id_col).withColumn("block", F.floor(F.col("pos") / rows).cast("long"))

    def packed(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        x = [np.array([[list(v) for v in s] for s in g[c]], "<f4").tobytes() for c in ("history", "target")]
        return pd.DataFrame([(g["block"].iloc[0], len(g), g[id_col].to_numpy("<i8").tobytes(), *x)], columns=[c.split()[0] for c in BLOCK.split(", ")])

    placed.select("block", "pos", id_col, "history", "target").groupBy("block").applyInPandas(packed, BLOCK).write.mode("overwrite").parquet(path)
    return samples.sparkSession.read.schema(BLOCK).parquet(path)


def tensors(row, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, histories and targets of a block."""
    n = row.n
    return np.frombuffer(row.ids, "<i8"), np.frombuffer(row.history, "<f4").reshape(n, shape.history, shape.size), np.frombuffer(row.target, "<f4").reshape(n, shape.target, shape.size)


def summed(blocks: DataFrame, f) -> np.ndarray | None:
    """The sum of f(row), an array, over all blocks: in the tasks, then in GROUPS groups, then on the driver."""

    def own(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for g in frames:
            for row in g.itertuples():
                x = f(row)
                total = x if total is None else total + x
        if total is not None:
            yield pd.DataFrame({"s": [total]})

    def added(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [np.sum(np.stack(g["s"].to_numpy()), axis=0)]})

    parts = blocks.mapInPandas(own, "s array<double>").withColumn("g", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    got = parts.groupBy("g").applyInPandas(lambda g: added(g), "s array<double>").collect()  # GROUPS rows
    return np.sum([np.array(r["s"]) for r in got], axis=0) if got else None


class Forecaster(ABC):
    """What is fitted on blocks of tensors and forecasts from them."""

    shape: Shape

    @abstractmethod
    def fit(self, blocks: DataFrame) -> Forecaster:
        """Fit on all samples of the blocks."""

    @abstractmethod
    def forecast(self, history: np.ndarray) -> np.ndarray:
        """Targets (sample, window, entry) from histories."""

    def predict(self, blocks: DataFrame, prototypes: DataFrame | None = None) -> DataFrame:
        """source_window_id, step, prediction, pattern_id, actual: a row a sample and target window. pattern_id is the nearest of the
        prototypes (pattern_id, v), of which there are few by definition; the smallest on a tie, null without any.
        """
        model, shape = self, self.shape
        known = [(r["pattern_id"], r["v"]) for r in prototypes.select("pattern_id", "v").orderBy("pattern_id").collect()] if prototypes is not None else []
        names, table = [k for k, _ in known], np.array([v for _, v in known], float)

        def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for g in frames:
                for row in g.itertuples():
                    ids, history, target = tensors(row, shape)
                    made = model.forecast(history.astype(float)).reshape(-1, shape.size)
                    near = [names[k] for k in np.round(((made[:, None] - table[None]) ** 2).sum(2), 9).argmin(1)] if names else None
                    out = {"source_window_id": np.repeat(ids, shape.target), "step": np.tile(np.arange(shape.target), len(ids)), "prediction": list(made), "pattern_id": near, "actual": list(target.reshape(-1, shape.size).astype(float))}
                    yield pd.DataFrame(out)

        return blocks.mapInPandas(run, "source_window_id long, step int, prediction array<double>, pattern_id int, actual array<double>")


@dataclass
class LastWindow(Forecaster):
    """Every target window is the history's last: the yardstick."""

    shape: Shape

    def fit(self, blocks: DataFrame) -> LastWindow:
        return self

    def forecast(self, history: np.ndarray) -> np.ndarray:
        return np.repeat(history[:, -1:], self.shape.target, axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Recurrent(Forecaster):
    """A gated recurrent network over the history, whose last state gives what is added to the last window; all normalised by the
    training samples' means and deviations. Squared error, Adam with weight decay. A batch is the blocks whose number and epoch hash
    to it, so batches are the same on any cluster.
    """

    shape: Shape
    hidden: int = 32
    epochs: int = 8
    batches: int = 4
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 42
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    scale: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self) -> dict[str, np.ndarray]:
        d, h, out = self.shape.size, self.hidden, self.shape.target * self.shape.size
        rng, limit = np.random.default_rng(self.seed), 1 / np.sqrt(self.hidden)
        draw = lambda *s: rng.uniform(-limit, limit, s)
        # no output weight: the network starts as the last window
        return {"w": draw(d, 3 * h), "u": draw(h, 3 * h), "b": draw(3 * h), "o": np.zeros((h, out)), "ob": np.zeros(out)}

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        h, p = self.hidden, self.weights
        state, past = np.zeros((len(x), h)), []
        for t in range(x.shape[1]):
            a, c = x[:, t] @ p["w"] + p["b"], state @ p["u"]
            z, r = _sigmoid(a[:, :h] + c[:, :h]), _sigmoid(a[:, h : 2 * h] + c[:, h : 2 * h])
            n = np.tanh(a[:, 2 * h :] + r * c[:, 2 * h :])
            past.append((x[:, t], state, z, r, n, c[:, 2 * h :]))
            state = (1 - z) * n + z * state
        return state, past

    def _normal(self, history: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = self.scale
        last = np.repeat((history[:, -1:] - s["target_mean"]) / s["target_std"], self.shape.target, axis=1)
        return (history - s["mean"]) / s["std"], last.reshape(len(history), -1)

    def gradient(self, history: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Squared error summed over samples and entries, and its gradient."""
        p, h = self.weights, self.hidden
        x, last = self._normal(history)
        state, past = self._forward(x)
        off = last + state @ p["o"] + p["ob"] - ((target - self.scale["target_mean"]) / self.scale["target_std"]).reshape(len(x), -1)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["o"], g["ob"] = state.T @ (2 * off), (2 * off).sum(0)
        back = 2 * off @ p["o"].T
        for own, before, z, r, n, c in reversed(past):
            dn = back * (1 - z) * (1 - n * n)
            dz = back * (before - n) * z * (1 - z)
            dr = dn * c * r * (1 - r)
            inner, outer = np.concatenate([dz, dr, dn], axis=1), np.concatenate([dz, dr, dn * r], axis=1)
            g["w"] += own.T @ inner
            g["b"] += inner.sum(0)
            g["u"] += before.T @ outer
            back = back * z + outer @ p["u"].T
        assert g["u"].shape == (h, 3 * h)
        return float((off * off).sum()), g

    def forecast(self, history: np.ndarray) -> np.ndarray:
        x, last = self._normal(history)
        out = last + self._forward(x)[0] @ self.weights["o"] + self.weights["ob"]
        return out.reshape(len(x), self.shape.target, self.shape.size) * self.scale["target_std"] + self.scale["target_mean"]

    def _scaled(self, blocks: DataFrame) -> None:
        shape = self.shape

        def moments(row) -> np.ndarray:
            _, history, target = tensors(row, shape)
            flat = [x.reshape(-1, shape.size).astype(float) for x in (history, target)]
            return np.concatenate([np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]) for x in flat])

        total = summed(blocks, moments)
        if total is None:
            raise ValueError("no sample to fit on")
        for name, v in zip(("", "target_"), np.split(total, 2), strict=True):
            n, s, ss = v[0], v[1 : 1 + shape.size], v[1 + shape.size :]
            mean = s / n
            deviation = np.sqrt(np.maximum(ss / n - mean * mean, 0.0))
            self.scale[f"{name}mean"], self.scale[f"{name}std"] = mean, np.where(deviation > 1e-6, deviation, 1.0)

    def fit(self, blocks: DataFrame) -> Recurrent:
        kept = blocks.persist(StorageLevel.MEMORY_AND_DISK)
        self._scaled(kept)
        self.weights = self.start()
        moving = Adam(self.rate, self.decay)
        for epoch in range(self.epochs):
            for batch in range(self.batches):
                got = summed(kept.filter(in_batch(epoch, batch, self.batches)), self._flat_gradient())
                if got is not None:
                    moving.step(self.weights, self.unflat(got[2:] / got[1]))
        kept.unpersist()
        return self

    def _flat_gradient(self):
        model, shape = self, self.shape

        def f(row) -> np.ndarray:
            _, history, target = tensors(row, shape)
            error, g = model.gradient(history.astype(float), target.astype(float))
            return np.concatenate([[error, target.size], *(g[k].ravel() for k in sorted(g))])

        return f

    def unflat(self, v: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k in sorted(self.weights):
            n = self.weights[k].size
            out[k] = v[at : at + n].reshape(self.weights[k].shape)
            at += n
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        """Parameters and scales as a table."""
        rows = [(kind, k, list(v.shape), v.ravel().tolist()) for kind, t in (("weights", self.weights), ("scale", self.scale)) for k, v in t.items()]
        spark.createDataFrame(rows, "kind string, name string, shape array<int>, x array<double>").write.mode("overwrite").parquet(path)

    def load(self, spark: SparkSession, path: str) -> Recurrent:
        for r in spark.read.parquet(path).collect():  # one row a parameter
            getattr(self, r["kind"])[r["name"]] = np.array(r["x"]).reshape(r["shape"])
        return self


def in_batch(epoch: int, batch: int, batches: int):
    return F.pmod(F.xxhash64("block", F.lit(epoch)), F.lit(batches)) == batch


@dataclass
class Adam:
    rate: float
    decay: float
    steps: int = 0
    first: dict[str, np.ndarray] = field(default_factory=dict)
    second: dict[str, np.ndarray] = field(default_factory=dict)

    def step(self, weights: dict[str, np.ndarray], gradient: dict[str, np.ndarray]) -> None:
        """Move the weights by one gradient."""
        self.steps += 1
        for k, g in gradient.items():
            self.first[k] = 0.9 * self.first.get(k, 0.0) + 0.1 * g
            self.second[k] = 0.999 * self.second.get(k, 0.0) + 0.001 * g * g
            m, v = self.first[k] / (1 - 0.9**self.steps), self.second[k] / (1 - 0.999**self.steps)
            weights[k] = weights[k] * (1 - self.rate * self.decay) - self.rate * m / (np.sqrt(v) + 1e-8)


def forecast_errors(predictions: DataFrame, baseline: DataFrame) -> DataFrame:
    """step, n, and mae and rmse of predictions and of a baseline's for the same samples: over all entries of the vectors."""
    own = ["source_window_id", "step"]
    both = predictions.select(*own, "actual", "prediction").join(baseline.select(*own, F.col("prediction").alias("base")), own)
    off = lambda c: F.zip_with("actual", c, lambda a, p: a - p)
    total = lambda c, f: F.aggregate(F.transform(off(c), f), F.lit(0.0), lambda s, x: s + x)
    cols = [total(c, f).alias(f"{name}_{c}") for c in ("prediction", "base") for name, f in (("a", F.abs), ("s", lambda x: x * x))]
    n = F.sum("k")
    by = both.select("step", F.size("actual").alias("k"), *cols).groupBy("step")
    return by.agg(F.count(F.lit(1)).alias("n"), *[e.alias(f"{label}{m}") for label, c in (("", "prediction"), ("baseline_", "base")) for m, e in (("mae", F.sum(f"a_{c}") / n), ("rmse", F.sqrt(F.sum(f"s_{c}") / n)))])


def split_blocks(samples: DataFrame, vectors: DataFrame, shape: Shape, path: str, rows: int = 64, names: Sequence[str] = ("train", "validation", "test")) -> dict[str, DataFrame]:
    """Blocks of the samples of each part of a chronological split. Samples of training whose targets reach into the validation's
    windows are left out, as they know what comes later.
    """
    from tidemark.operators.samples import chronological_split

    parts = chronological_split(samples.select("source_window_id", "history_ids", "target_ids"), "source_window_id").drop("pos")
    first = parts.filter(F.col("split") != names[0]).agg(F.min("source_window_id")).first()[0]
    parts = parts.filter((F.col("split") != names[0]) | (F.array_max("target_ids") < F.lit(first)) if first is not None else F.lit(True))
    every = sample_vectors(parts, vectors).join(parts.select("source_window_id", "split"), "source_window_id")
    every.write.mode("overwrite").parquet(f"{path}/samples")
    stored = samples.sparkSession.read.parquet(f"{path}/samples")
    return {name: tensor_blocks(stored.filter(F.col("split") == name), shape, f"{path}/{name}", rows) for name in names}
