"""The segment equations and the walk for SQL: a function of a fit and a step, and a table function from series to segments."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import Row

from tidemark.functions.equations import FIT, HARMONIC_SET, OMEGA, PLAIN_SET, Walk

SEGMENTS = "channel string, segment_id long, start_idx long, end_idx long, duration long, x0 double, " + FIT
_FIT = [c.split()[0] for c in FIT.split(", ")]
#: Rows that are walked at once.
PORTION = 1024

_VALUE = f"""
CREATE OR REPLACE TEMPORARY FUNCTION segment_value(eq_type STRING, L DOUBLE, c DOUBLE, lam DOUBLE, A DOUBLE, B DOUBLE, t DOUBLE)
RETURNS DOUBLE
RETURN CASE eq_type
  WHEN 'linear' THEN L + c * t
  WHEN 'exponential' THEN L + A * exp(-lam * t)
  WHEN 'harmonic' THEN L + A * cos({OMEGA!r}D * t) + B * sin({OMEGA!r}D * t)
  WHEN 'linear_harmonic' THEN L + c * t + A * cos({OMEGA!r}D * t) + B * sin({OMEGA!r}D * t)
  WHEN 'damped_harmonic' THEN L + exp(-lam * t) * (A * cos({OMEGA!r}D * t) + B * sin({OMEGA!r}D * t))
  ELSE L END"""


@udtf(returnType=SEGMENTS)
class WalkSegments:
    """Segments of TABLE(channel, idx, x) PARTITION BY channel ORDER BY (idx), within a tolerance, with or without harmonics. Rows
    come one by one; no more of a series is held than its open segment and a portion.
    """

    def __init__(self):
        self.walk, self.channel, self.n = None, None, 0
        self.places: list[int] = []  # of the open segment and the portion
        self.values: list[float] = []
        self.waiting = 0

    def eval(self, row: Row, tolerance: float, harmonic: bool):
        if self.walk is None:
            self.walk = Walk(float(tolerance), 24, HARMONIC_SET if harmonic else PLAIN_SET, 10.0 if harmonic else 5.0)
            self.channel = row["channel"]
        self.places.append(row["idx"])
        self.values.append(float("nan") if row["x"] is None else float(row["x"]))
        self.waiting += 1
        if self.waiting == PORTION:
            yield from self._closed(False)

    def terminate(self):
        if self.walk is not None:
            yield from self._closed(True)

    def _closed(self, last: bool):
        before, new = self.walk.start, self.values[len(self.values) - self.waiting :]
        self.waiting = 0
        for a, z, f in self.walk.feed(new, last):
            yield (self.channel, self.n, self.places[a - before], self.places[z - before], z - a + 1, self.values[a - before], *(getattr(f, c) for c in _FIT))
            self.n += 1
        gone = self.walk.start - before
        self.places, self.values = self.places[gone:], self.values[gone:]


def register(spark: SparkSession) -> None:
    """segment_value(eq_type, L, c, lam, A, B, t) and walk_segments(TABLE(...) PARTITION BY channel ORDER BY (idx), tolerance, harmonic)."""
    spark.sql(_VALUE)
    spark.udtf.register("walk_segments", WalkSegments)
