"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Class means and covariances come from one aggregation over all labelled training rows (sums and
outer products per task, then summed). Each covariance is shrunk towards the pooled one and that
towards the pooled variances alone, and factored once by Cholesky. A document's margin is the difference
of the two log densities, taken from Mahalanobis distances by triangular solves, plus the
log ratio of priors. A logistic curve, fitted on the margins' histogram, turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import written
from tidemark.llm.words import Words, slices

NAMES = ["log_words", "word_length", "symbols", "upper", "digits", "bangs", "bars", "marks", "distinct", "repeats", "dup_lines", "line_words"]
_CLASS = np.zeros(256, dtype=np.uint8)
for _i, _chars in enumerate((b"#*$%&<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b"|", b".,;:"), start=1):
    _CLASS[list(_chars)] = _i


def statistics(words: Words) -> np.ndarray:
    """Rows of transformed statistics, one per text; a text without words gets zeros but for what that implies."""
    n_docs = len(words)
    n = np.diff(words.doc_at).astype(float)
    some = np.maximum(n, 1)
    doc = np.repeat(np.arange(n_docs), np.diff(words.offsets))
    kinds = np.bincount(doc * 8 + _CLASS[words.data], minlength=n_docs * 8).reshape(n_docs, 8).astype(float)
    chars = np.maximum(np.bincount(np.repeat(np.arange(n_docs), np.diff(words.doc_at)), weights=(words.ends - words.starts), minlength=n_docs), 1)
    owner = np.repeat(np.arange(n_docs), np.diff(words.doc_at))
    distinct, again, dup, per_line = (np.zeros(n_docs) for _ in range(4))
    pair_at, pair = words.windows(2)
    cut = np.searchsorted(pair_at, words.doc_at)
    same = np.zeros(len(owner), dtype=bool)
    if len(owner) > 1:
        same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
    runs = np.bincount(owner, weights=same, minlength=n_docs)
    for i in range(n_docs):
        a, z = words.doc_at[i], words.doc_at[i + 1]
        if z > a:
            # distinct word pairs, on a scale that doesn't fall with length as distinct words do
            p = pair[cut[i] : cut[i + 1]]
            distinct[i] = len(np.unique(p)) / len(p) if len(p) else 1.0
            lines = words.data[words.offsets[i] : words.offsets[i + 1]].tobytes().split(b"\n")
            full = [x for x in lines if x and not x.isspace()]
            dup[i] = 1 - len(set(full)) / max(len(full), 1)
            per_line[i] = (z - a) / max(len(full), 1)
    again = runs / some
    share = kinds[:, 1:7] / chars[:, None]
    x = np.column_stack([np.log1p(n), np.log1p(chars / some), *(np.sqrt(share[:, k]) for k in range(6)), 1 - distinct, np.sqrt(again), np.sqrt(dup), np.log1p(per_line)])
    x[n == 0] = 0
    return x


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, 2):
            x = statistics(Words(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["id", "crc", "x"])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray  # class by dimension
    lower: np.ndarray  # class by dimension by dimension: Cholesky factors
    constant: np.ndarray  # log prior less half the log determinant
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        log = []
        for m, low, c in zip(self.mean, self.lower, self.constant, strict=True):
            z = np.linalg.solve(low, (x - m).T)
            log.append(c - 0.5 * (z * z).sum(0))
        return log[1] - log[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -700, 700)))


def _moments(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, list] = {}
    for f in frames:
        for y, g in f.groupby("y"):
            x = np.stack(g["x"].to_numpy())
            t = total.setdefault(int(y), [0, 0.0, 0.0])
            t[0] += len(x)
            t[1] = t[1] + x.sum(0)
            t[2] = t[2] + (x[:, :, None] * x[:, None, :]).sum(0)
    yield pd.DataFrame([(y, t[0], list(np.concatenate([t[1], t[2].ravel()]))) for y, t in total.items()], columns=["y", "n", "sums"])


def discriminant(n: np.ndarray, s: np.ndarray, ss: np.ndarray, to_pooled: float = 0.3, to_round: float = 0.05) -> Model:
    """From each class's count, sums and sums of outer products. Classes of few rows are shrunk further: their own
    covariance counts for no more than their rows per dimension.
    """
    d = s.shape[1]
    mean = s / np.maximum(n, 1)[:, None]
    scatter = ss - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    pooled = scatter.sum(0) / max(n.sum(), 1)
    lower, constant = [], []
    for k in range(2):
        few = min(1.0, d / max(n[k], 1))
        own, even = max(to_pooled, few), max(to_round, few / 2)
        c = (1 - own) * scatter[k] / max(n[k], 1) + own * pooled
        c = (1 - even) * c + even * np.diag(np.diag(pooled)) + 1e-4 * np.eye(d)
        low = np.linalg.cholesky((c + c.T) / 2)
        lower.append(low)
        constant.append(np.log(max(n[k], 0.5) / max(n.sum(), 1)) - np.log(np.diag(low)).sum())
    return Model(mean, np.array(lower), np.array(constant))


def calibrated(model: Model, bins: pd.DataFrame, width: float) -> Model:
    """The logistic curve of greatest likelihood over (bin, y, n), with a weak prior."""
    m, y, n = (bins["bin"].to_numpy() + 0.5) * width, bins["y"].to_numpy(float), bins["n"].to_numpy(float)
    w, scale = np.array([0.1, 0.0]), max(n.sum(), 1)
    x = np.column_stack([m, np.ones_like(m)])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - y)) / scale + 1e-3 * (w - [0.1, 0])
        h = (x * (n * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x / scale + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 1.0 / max(1e-12, np.abs(step * [10, 1]).max()))
        if np.abs(step).max() < 1e-8:
            break
    return Model(model.mean, model.lower, model.constant, float(w[0]), float(w[1]))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")).alias("crc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return written(src.mapInArrow(_features, "id long, crc long, x array<double>"))


def fit(rows: DataFrame, labels: DataFrame, folds: int = 5, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Fit on all labelled rows whose crc32(id as text) mod folds is not 0. Without rows of both classes: score 0.5 for all."""
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    train = written(rows.filter(F.col("crc") % folds != 0).join(known, "id").select("x", "y"))
    sums = train.mapInPandas(_moments, "y int, n long, sums array<double>")
    total = sums.groupBy("y").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(len(NAMES) * (len(NAMES) + 1))]).collect()
    d = len(NAMES)
    n, s, ss = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in total:
        v = np.array([r[f"s{i}"] for i in range(d * (d + 1))], dtype=float)
        n[r["y"]], s[r["y"]], ss[r["y"]] = r["n"], v[:d], v[d:].reshape(d, d)
    if n.min() == 0:
        return Model(np.zeros((2, d)), np.array([np.eye(d)] * 2), np.zeros(2))
    model, width = discriminant(n, s, ss), 0.25

    def margins(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                m = np.clip(model.margin(np.stack(f["x"].to_numpy())), -250, 250)
                yield pd.DataFrame({"bin": np.floor(m / width).astype(int), "y": f["y"]})

    bins = train.mapInPandas(margins, "bin int, y int").groupBy("bin", "y").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most 4,000 rows
    return calibrated(model, bins, width)


def scored(rows: DataFrame, model: Model, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                s = model.score(np.stack(f["x"].to_numpy()))
                yield pd.DataFrame({"id": f["id"], "held_out": f["crc"] % folds == 0, "score": s, "predicted": (s >= threshold).astype(int)})

    return rows.mapInPandas(run, "id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, held_out, score, predicted.

    A null or empty text has the statistics of no words and gets their score. Rows that repeat an id are
    scored each; a label repeated with both values counts as 1. A null id is scored, and is no training row.
    An empty table gives an empty result. Only the named columns are read; labels never enter a score.
    """
    rows = features(docs, id_col, text_col)
    return scored(rows, fit(rows, labels, folds), folds, threshold).withColumnRenamed("id", id_col)
