"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import written

#: Edges that a task draws together at once.
CHUNK = 250_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node but the smallest of its component to that one, for edges a, b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label != (onward := label[label])).any():
            label = onward
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    out = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[out], nodes[label[out]]


def _stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def sent() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*(np.concatenate(x) for x in zip(*held, strict=True)))], ["a", "b"])

    for x in batches:
        held.append((x.column(0).to_numpy(), x.column(1).to_numpy()))
        n += len(x)
        if n >= CHUNK:
            yield sent()
            held, n = [], 0
    if n:
        yield sent()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, label: the smallest node that can be reached.

    Tasks first replace their edges by stars, which link the same nodes in fewer steps. Each round takes the smallest label
    among the neighbours and then the label of that label, so rounds grow with the logarithm of a component's diameter. A node
    in very many edges is pre-aggregated by min() before the shuffle; every round is written, so none is worked out twice.
    """
    pairs = written(edges.filter("a <> b").select("a", "b").mapInArrow(_stars, "a long, b long"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("onward"))
        step = written(step.join(jump, "low", "left").select("node", F.col("label").alias("was"), F.least("low", F.coalesce("onward", "low")).alias("label")))
        labels = step.select("node", "label")
        if step.filter("was <> label").isEmpty():
            return labels
