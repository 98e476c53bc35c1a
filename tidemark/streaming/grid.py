"""The hourly grid and its extrema on a stream of events.

Late events are taken up to the watermark; an hour is given out once, when no event of it can come any more. The extrema
of an hourly stream need three neighbouring differences per channel, which is the state that is kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "channel string, ts timestamp, sign string, amplitude double, first_diff double"
STATE = "last_ts timestamp, xs array<double>"


def deduplicated(events: DataFrame, ids: Sequence[str], late: str = "2 hours", ts: str = "ts") -> DataFrame:
    """The first of all events with the same ids that come within the watermark's delay of one another; events without a time are left
    out. Ids are kept as long as the delay, so the state has the last hours' ids and not the stream's.
    """
    return events.filter(F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(list(ids))


def late_rows(progress: Sequence[dict]) -> int:
    """Rows that came after the watermark and were left out, of a query's progress reports (``query.recentProgress``). A stateful operator
    counts them as it sees them: those behind a partial aggregate as groups.
    """
    return sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])


def hourly(events: DataFrame, late: str = "2 hours", channel: str = "event_type", value: str = "value", ts: str = "ts", ids: Sequence[str] = ()) -> DataFrame:
    """channel, ts, x: hourly means of a stream (or, the same, of a table). With ``ids``, events that are sent again count once."""
    rows = deduplicated(events, ids, late, ts) if ids else events
    rows = rows.select(F.col(channel).alias("channel"), (F.col(ts) if ids else F.col(ts).cast("timestamp")).alias("ts"), F.col(value).cast("double").alias("v"))
    rows = rows if ids else rows.withWatermark("ts", late)
    return rows.groupBy("channel", F.window("ts", "1 hour")).agg(F.avg("v").alias("x")).select("channel", F.col("window.start").alias("ts"), "x")


def _turns(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, xs = state.get if state.exists else (None, [])
    xs, out = list(xs), []
    rows = pd.concat(list(frames)).sort_values("ts")
    for ts, x in zip(rows["ts"], rows["x"], strict=True):
        if last is not None and (ts - last) != pd.Timedelta(hours=1):
            xs = []  # a missing hour: differences don't reach across it
        xs, last = [*xs, float(x)][-4:], ts
        if len(xs) == 4:
            p, c, n = xs[1] - xs[0], xs[2] - xs[1], xs[3] - xs[2]
            if p < c >= n or p > c <= n:
                out.append((key[0], ts - pd.Timedelta(hours=1), "max" if p < c else "min", abs(c - (p + n) / 2), c))
    state.update((last, xs))
    yield pd.DataFrame(out, columns=["channel", "ts", "sign", "amplitude", "first_diff"])


def extrema(hours: DataFrame) -> DataFrame:
    """EVENT rows for the extrema of the first difference of an hourly stream, unsmoothed, as soon as the next hour is known.

    ``hours`` is a stream of the table that hourly() is written to: Spark keeps no state of one's own behind an aggregate.
    """
    return hours.groupBy("channel").applyInPandasWithState(_turns, EVENT, STATE, "append", GroupStateTimeout.NoTimeout)
