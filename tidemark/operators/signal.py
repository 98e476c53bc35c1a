"""The long signal table: one row per series, channel and step.

Columns: the keys, idx (step from 0), ts, x (raw), s (smoothed), d1 and d2 (first and second difference).
Windows are partitioned by the keys, so series and channels run in parallel. Frames that reach to a series' end are
read from the end: a frame that only grows is kept up to date, one that shrinks would be summed anew for each row.
With ``places`` values are rounded, so that comparing neighbours doesn't depend on the order of a sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("channel",)


def series_keys(*tables: DataFrame) -> tuple[str, ...]:
    """The column that tells series apart, if all of the tables have it."""
    return ("series_id",) if all("series_id" in t.columns for t in tables) else ()


def ordered(keys: Sequence[str] = KEYS):
    return Window.partitionBy(*keys).orderBy("idx")


def backwards(keys: Sequence[str] = KEYS):
    """The series from its end: rows up to the current one are those from it on."""
    return Window.partitionBy(*keys).orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)


def placed(x: Column, places: int | None) -> Column:
    return x if places is None else F.round(x, places)


def hourly_grid(events: DataFrame, channel: str = "event_type", value: str = "value", ts: str = "ts", places: int | None = None) -> DataFrame:
    """Hourly means by channel on a dense calendar: channel, idx, ts, x (null where an hour has no event).

    Events are averaged per hour before anything else, so what windows see grows with hours, not events.
    """
    hour = F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz")
    hours = events.groupBy(F.col(channel).alias("channel"), hour.alias("ts")).agg(F.avg(F.nanvl(F.col(value), F.lit(None))).alias("x"))
    span = hours.agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.sort_array(F.collect_set("channel")).alias("channels"))
    dense = span.select("t0", F.explode("channels").alias("channel"), F.expr("sequence(t0, t1, interval 1 hour)").alias("all"))
    dense = dense.select("channel", F.posexplode("all").alias("idx", "ts"))
    return dense.join(hours, ["channel", "ts"], "left").select("channel", F.col("idx").cast("long").alias("idx"), "ts", placed(F.col("x"), places).alias("x"))


def quality_masked(wide: DataFrame, pairs: Sequence[tuple[str, str]], highest: int = 2) -> DataFrame:
    """Null each value whose flag is missing or above ``highest``."""
    return wide.withColumns({v: F.when(F.coalesce(F.col(q), F.lit(highest + 1)) <= highest, F.col(v)) for v, q in pairs})


def date_slice(df: DataFrame, first: str | None = None, last: str | None = None, ts: str = "ts") -> DataFrame:
    """Rows between two times, both included; only filters on the column, so Parquet scans can prune."""
    for bound, op in ((first, "__ge__"), (last, "__le__")):
        if bound is not None:
            df = df.filter(getattr(F.col(ts), op)(F.lit(bound).cast("timestamp_ntz")))
    return df


def reindexed(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = "ts", max_rows: int | None = None) -> DataFrame:
    """Number steps from 0 again after filters; with max_rows only the first ones stay."""
    df = df.withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy(ts)).cast("long") - 1)
    return df if max_rows is None else df.filter(F.col("idx") < max_rows)


def to_long(wide: DataFrame, channels: Sequence[str], ts: str = "ts", keep: Sequence[str] = ()) -> DataFrame:
    """One row per channel from one column per channel, without a shuffle."""
    parts = F.array(*[F.struct(F.lit(c).alias("channel"), F.nanvl(F.col(c).cast("double"), F.lit(None)).alias("x")) for c in channels])
    return wide.select(*keep, F.col(ts).alias("ts"), F.explode(parts).alias("p")).select(*keep, "p.channel", "ts", "p.x")


def to_wide(long: DataFrame, channels: Sequence[str], value: str = "x", by: Sequence[str] = ("idx", "ts")) -> DataFrame:
    return long.groupBy(*by).pivot("channel", list(channels)).agg(F.first(value))


def rolling_mean(x: Column, width: int = 5, keys: Sequence[str] = KEYS, places: int | None = None) -> Column:
    """Centred mean of the values that are there."""
    return placed(F.avg(x).over(ordered(keys).rowsBetween(-(width // 2), (width - 1) // 2)), places)


#: Weights of the 7-point quadratic Savitzky-Golay filter, times 21.
SAVGOL_7_2 = (-2, 3, 6, 7, 6, 3, -2)


def linear_filled(x: Column, keys: Sequence[str] = KEYS) -> Column:
    """Nulls filled on the line between their neighbours; beyond the ends with the nearest value."""
    w, at = ordered(keys), F.when(x.isNotNull(), F.col("idx"))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), backwards(keys)
    i0, i1, x0, x1 = F.last(at, True).over(back), F.last(at, True).over(ahead), F.last(x, True).over(back), F.last(x, True).over(ahead)
    return F.coalesce(x, F.when(i0.isNotNull() & i1.isNotNull(), x0 + (x1 - x0) * (F.col("idx") - i0) / (i1 - i0)), x0, x1)


def savgol(grid: DataFrame, keys: Sequence[str] = KEYS, places: int | None = None) -> DataFrame:
    """grid with s: Savitzky-Golay of width 7 and degree 2 over the filled series. The three values at either
    end lie on the quadratic through the first or last seven points; a series of fewer than seven keeps its values.
    """
    w = ordered(keys)
    filled = grid.withColumn("_f", linear_filled(F.col("x"), keys)).withColumn("_n", F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    middle = sum(F.lead("_f", k - 3).over(w) * c if k > 3 else (F.lag("_f", 3 - k).over(w) if k < 3 else F.col("_f")) * c for k, c in enumerate(SAVGOL_7_2)) / 21.0
    # the least-squares quadratic of seven points at offsets -3..3 from their middle
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for end, first in (("_a", F.lit(0)), ("_z", F.col("_n") - 7)):
        filled = filled.withColumn(end, F.collect_list(F.when(F.col("idx").between(first, first + 6), F.col("_f"))).over(whole))
    u = F.when(F.col("idx") < 3, F.col("idx") - 3).otherwise(F.col("idx") - F.col("_n") + 4)

    def quadratic(arr: str) -> Column:
        y = [F.try_element_at(F.col(arr), F.lit(k + 1)) for k in range(7)]
        p0 = sum(v * c for v, c in zip(y, SAVGOL_7_2, strict=True)) / 21.0
        p1 = sum(v * (k - 3) for k, v in enumerate(y)) / 28.0
        p2 = sum(v * c for v, c in zip(y, (5, 0, -3, -4, -3, 0, 5), strict=True)) / 84.0
        return p0 + p1 * u + p2 * u * u

    s = F.when(F.col("_n") < 7, F.col("_f")).when(F.col("idx") < 3, quadratic("_a")).when(F.col("idx") >= F.col("_n") - 3, quadratic("_z")).otherwise(middle)
    return filled.withColumn("s", placed(s, places)).drop("_f", "_n", "_a", "_z")


def signal(grid: DataFrame, method: str = "rolling_mean", width: int = 5, keys: Sequence[str] = KEYS, places: int | None = None) -> DataFrame:
    """grid with s, d1 and d2. All of it is one sort by the keys and idx."""
    if method == "rolling_mean":
        out = grid.withColumn("s", rolling_mean(F.col("x"), width, keys, places))
    elif method == "savgol":
        out = savgol(grid, keys, places)
    else:
        raise ValueError(f"unknown smoothing method: {method}")
    w = ordered(keys)
    out = out.withColumn("d1", placed(F.col("s") - F.lag("s").over(w), places))
    return out.withColumn("d2", placed(F.col("d1") - F.lag("d1").over(w), places))
