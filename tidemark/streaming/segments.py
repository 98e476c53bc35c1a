"""Walk-forward segmentation of a stream: a segment is given out once, when a step that its equation can't hold has come.

The state of a series is its open segment: its points and the equation that holds them. It is as long as that segment, not as the
series, and a query that is started again from its checkpoint walks on from there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.equations import FIT, HARMONIC_SET, PLAIN_SET, Fit, Walk

STATE = "segment_id long, start long, held long, places array<long>, y array<double>, " + FIT
CLOSED = "segment_id long, start_idx long, end_idx long, duration long, x0 double, " + FIT
_FIT = [c.split()[0] for c in FIT.split(", ")]
_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which typed state needs."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


class _Segments(StatefulProcessor):
    def __init__(self, n_keys: int, tolerance: float, harmonic: bool, first: int, names: Sequence[str]):
        self.n_keys, self.tolerance, self.harmonic, self.first, self.names = n_keys, tolerance, harmonic, first, list(names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        walk, n, places = Walk(self.tolerance, self.first, HARMONIC_SET if self.harmonic else PLAIN_SET, 10.0 if self.harmonic else 5.0), 0, np.zeros(0, np.int64)
        if self.state.exists():
            n, walk.start, walk.at, seen, y, *fit = self.state.get()
            places, walk.open = np.array(seen, np.int64), np.array(y, float)
            walk.fit = Fit(*fit) if fit[0] is not None else None
        new = pd.concat(list(rows)).sort_values("row_place", kind="stable").drop_duplicates("row_place")
        if len(places):  # the open segment always has a point, so its last place is the last of the series
            new = new[new["row_place"] > places[-1]]
        before = walk.start
        places = np.concatenate([places, new["row_place"].to_numpy(np.int64)])
        y = np.concatenate([walk.open, new["row_value"].to_numpy(float)])
        out = []
        for a, z, f in walk.feed(new["row_value"].to_numpy(float)):
            out.append((*key, n, places[a - before], places[z - before], z - a + 1, y[a - before], *(getattr(f, c) for c in _FIT)))
            n += 1
        fit = [getattr(walk.fit, c) for c in _FIT] if walk.fit else [None] * len(_FIT)
        self.state.update((n, walk.start, walk.at, places[walk.start - before :].tolist(), walk.open.tolist(), *fit))
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def closed_segments(series: DataFrame, tolerance: float = 1.0, harmonic: bool = True, value: str = "x", keys: Sequence[str] = ("channel",), order: str = "idx", first: int = 24) -> DataFrame:
    """keys and CLOSED columns of a stream's series: what segmented() gives for the same points but for each series' last segment,
    which stays open. ``order`` is a whole number or a timestamp, and so are start_idx and end_idx.

    A micro-batch is taken in order; of rows of one place the first counts, and rows at or before a series' last place are too
    late and left out. Rows without a place are left out; a missing value never ends a segment.
    """
    time = dict(series.dtypes)[order].startswith("timestamp")
    at = F.unix_micros(F.col(order).cast("timestamp")) if time else F.col(order).cast("long")
    rows = series.select(*keys, at.alias("row_place"), F.col(value).cast("double").alias("row_value")).filter("row_place is not null")
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in series.select(*keys).schema) + CLOSED
    names = [*keys, *(c.split()[0] for c in CLOSED.split(", "))]
    out = rows.groupBy(*keys).transformWithStateInPandas(_Segments(len(keys), tolerance, harmonic, first, names), schema, "Append", "None")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("start_idx", "end_idx")}) if time else out
