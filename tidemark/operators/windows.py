"""Sliding windows and their features, as frames over one sort of the signal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.events import with_extrema, with_peaks
from tidemark.operators.signal import KEYS, ordered, series_keys


def frame(length: int, keys: Sequence[str] = KEYS):
    """The window of ``length`` steps that starts on a row."""
    return ordered(keys).rowsBetween(0, length - 1)


def starts(df: DataFrame, length: int, stride: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows on which a whole window starts, with window_id; none in a series shorter than a window."""
    last = F.max("idx").over(Window.partitionBy(*keys))
    out = df.withColumn("_last", last).filter((F.col("idx") % stride == 0) & (F.col("idx") + length - 1 <= F.col("_last"))).drop("_last")
    return out.withColumn("window_id", F.floor(F.col("idx") / stride).cast("long"))


def _or0(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _delta(values: Column, k: int) -> Column:
    """Last value less the one k finite values before it; less the first if there are no more than k."""
    n = F.size(values)
    before = F.when(n > k, F.try_element_at(values, F.lit(-1 - k))).otherwise(F.try_element_at(values, F.lit(1)))
    return _or0(F.try_element_at(values, F.lit(-1)) - before)


def intra_features(sig: DataFrame, length: int = 24, stride: int = 1, keys: Sequence[str] = KEYS) -> DataFrame:
    """13 features of each window and channel over the smoothed values that are there; 0 where there is none."""
    f, s = frame(length, keys), F.col("s")
    out = with_extrema(sig, keys).withColumn("_v", F.collect_list("s").over(f))
    out = out.withColumns(
        {
            "current_value": _or0(F.last(s, True).over(f)),
            "delta_1": _delta(F.col("_v"), 1),
            "delta_6": _delta(F.col("_v"), 6),
            "delta_24": _delta(F.col("_v"), 24),
            "second_diff": _or0(F.last("d2", True).over(f)),
            "mean": _or0(F.avg(s).over(f)),
            "variance": _or0(F.var_pop(s).over(f)),
            "integral": _or0(F.sum(s).over(f)),
            "max": _or0(F.max(s).over(f)),
            "min": _or0(F.min(s).over(f)),
            "range": _or0(F.max(s).over(f) - F.min(s).over(f)),
            "extrema_count": F.count("ext_sign").over(f).cast("double"),
            "extrema_amplitude_sum": _or0(F.sum("ext_amplitude").over(f)),
        }
    )
    return starts(out, length, stride, keys).select("window_id", *keys, *INTRA)


#: The features of a window and channel, of a window and pair, and the hazard features, in order.
INTRA = ("current_value", "delta_1", "delta_6", "delta_24", "second_diff", "mean", "variance", "integral", "max", "min", "range", "extrema_count", "extrema_amplitude_sum")
INTER = ("correlation", "lag_correlation", "slope_ratio", "sync_count", "mean_event_lag")
HAZARD = ("n_peaks", "max_peak_value", "mean_prominence", "max_prominence", "mean_width", "max_width", "max_rise_slope", "duration_over", "upper_tail", "lower_tail", "cumulative_risk", "hazard_flag", "compound_flag")


def thresholds(grid: DataFrame, upper: float = 0.9, lower: float = 0.1, keys: Sequence[str] = KEYS) -> DataFrame:
    """Exact quantiles, interpolated, of each channel's raw values: keys, upper, lower (0 if there are none)."""
    both = grid.groupBy(*keys).agg(F.percentile("x", F.lit(upper)).alias("upper"), F.percentile("x", F.lit(lower)).alias("lower"))
    return both.withColumns({c: _or0(F.col(c)) for c in ("upper", "lower")})


def hazard_features(sig: DataFrame, bounds: DataFrame, pair: tuple[str, str] | None = None, length: int = 24, stride: int = 1, keys: Sequence[str] = KEYS) -> DataFrame:
    """13 hazard features of each window and channel over raw values and peaks.

    bounds has one row per channel (of a series). ``pair`` names the two channels whose joint excess makes
    a compound event; the flag is the same for all channels.
    """
    f = frame(length, keys)
    x, u, low = F.col("x"), F.col("upper"), F.col("lower")
    out = with_peaks(sig, keys).join(bounds, list(keys))
    side = [k for k in keys if k != "channel"]
    joint = F.lit(0)
    if pair:
        joint = F.max(F.when((F.col("channel") == pair[0]) & (_or0(x) >= u), 1).otherwise(0)).over(Window.partitionBy(*side, "idx"))
        joint = joint * F.max(F.when((F.col("channel") == pair[1]) & (_or0(x) >= u), 1).otherwise(0)).over(Window.partitionBy(*side, "idx"))
    out = out.withColumn("_joint", joint)
    duration, up = _or0(F.sum(F.when(x > u, 1.0)).over(f)), _or0(F.sum(F.greatest(x - u, F.lit(0.0))).over(f))
    down = _or0(F.sum(F.when(x.isNotNull(), F.greatest(low - x, F.lit(0.0)))).over(f))
    top = F.when(F.col("peak_sign").isNotNull(), F.col("s"))
    out = out.withColumns(
        {
            "n_peaks": F.count("peak_sign").over(f).cast("double"),
            "max_peak_value": _or0(F.max(top).over(f)),
            "mean_prominence": _or0(F.avg("prominence").over(f)),
            "max_prominence": _or0(F.max("prominence").over(f)),
            "mean_width": _or0(F.avg("width").over(f)),
            "max_width": _or0(F.max("width").over(f)),
            "max_rise_slope": _or0(F.max("rise_slope").over(f)),
            "duration_over": duration,
            "upper_tail": up,
            "lower_tail": down,
            "compound_flag": F.max("_joint").over(f).cast("double"),
        }
    )
    out = out.withColumn("cumulative_risk", F.col("upper_tail") + F.col("lower_tail") + F.col("duration_over"))
    out = out.withColumn("hazard_flag", F.when((F.col("duration_over") > 0) | (F.col("cumulative_risk") > 0), 1.0).otherwise(0.0))
    return starts(out, length, stride, keys).select("window_id", *keys, *HAZARD)


def event_bridge(events: DataFrame, n_steps: int, length: int = 24, stride: int = 1) -> DataFrame:
    """(window_id, event columns): each event with every window that holds it. An event lies in length / stride windows
    at most, so it is exploded into them; there is no range join.
    """
    n_windows = max(0, (n_steps - length) // stride + 1)
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - (length - 1)) / stride)).cast("long")
    last = F.least(F.lit(n_windows - 1), F.floor(F.col("idx") / stride)).cast("long")
    return events.withColumn("window_id", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))


def ranges_bridge(events: DataFrame, ranges: DataFrame, bucket: int = 64) -> DataFrame:
    """Events with the variable ranges (range_id, start_idx, end_idx) that hold them: ranges are exploded into buckets of
    steps, the join is on the bucket (of the series), and the bounds are checked within it.
    """
    keys = series_keys(events, ranges)
    r = ranges.filter("end_idx >= start_idx").withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_idx") / bucket), F.floor(F.col("end_idx") / bucket))))
    return events.withColumn("_b", F.floor(F.col("idx") / bucket)).join(r, [*keys, "_b"]).filter(F.col("idx").between(F.col("start_idx"), F.col("end_idx"))).drop("_b")


def time_block(bridge: DataFrame, peaks_bridge: DataFrame, length: int = 24, stride: int = 1) -> DataFrame:
    """Per window (of a series): gaps between events of all channels (mean, population variance), peak widths (mean, max), event places
    as shares of the window. bridge and peaks_bridge are what event_bridge() gives for extrema and for peaks.
    """
    keys = [*series_keys(bridge, peaks_bridge), "window_id"]
    w = Window.partitionBy(*keys).orderBy("idx", "channel")
    gaps = bridge.withColumn("gap", (F.col("idx") - F.lag("idx").over(w)).cast("double")).withColumn("place", (F.col("idx") - F.col("window_id") * stride) / F.lit(max(length - 1, 1)))
    a = gaps.groupBy(*keys).agg(F.avg("gap").alias("mean_gap"), F.var_pop("gap").alias("var_gap"), F.count(F.lit(1)).alias("n_events"), F.transform(F.array_sort(F.collect_list(F.struct("idx", "channel", "place"))), lambda v: v["place"]).alias("places"))
    b = peaks_bridge.groupBy(*keys).agg(F.avg("width").alias("mean_width"), F.max("width").alias("max_width"))
    out = a.join(b, keys, "full")
    return out.select(*keys, *[_or0(F.col(c)).alias(c) for c in ("mean_gap", "var_gap", "mean_width", "max_width")], F.coalesce("n_events", F.lit(0)).alias("n_events"), F.coalesce("places", F.array().cast("array<double>")).alias("places"))
