"""Vectors of segments and windows, and their way back to values: scalar expressions on columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

import math


def time_features(ts: Column) -> list[Column]:
    """Sine and cosine of the day of the year and of the hour."""
    day, hour = 2 * math.pi * F.dayofyear(ts) / 365, 2 * math.pi * F.hour(ts) / 24
    return [F.sin(day).alias("doy_sin"), F.cos(day).alias("doy_cos"), F.sin(hour).alias("hour_sin"), F.cos(hour).alias("hour_cos")]


def one_hot(kind: Column, kinds: Sequence[str]) -> Column:
    return F.array(*[F.when(kind == k, 1.0).otherwise(0.0) for k in kinds])


def largest(v: Column, kinds: Sequence[str]) -> Column:
    """The kind whose place holds the greatest entry; the first on a tie."""
    return F.element_at(F.array(*[F.lit(k) for k in kinds]), F.array_position(v, F.array_max(v)).cast("int"))


def segment_vector(kinds: Sequence[str], scales: dict[str, float], params: Sequence[str] = ("L", "c", "lam", "A", "B"), day: float = 24.0) -> Column:
    """One-hot equation, scaled parameters, duration in days."""
    parts = [F.coalesce(F.col(p) / F.lit(float(scales.get(p, 1.0))), F.lit(0.0)) for p in params]
    return F.concat(one_hot(F.col("eq_type"), kinds), F.array(*parts, F.col("duration") / day))


def segment_of(v: Column, kinds: Sequence[str], scales: dict[str, float], params: Sequence[str] = ("L", "c", "lam", "A", "B"), day: float = 24.0) -> Column:
    """The segment that a vector stands for: rates not below 0, a duration of at least 1, rounded half to even."""
    k = len(kinds)
    at = {p: F.element_at(v, k + 1 + i) * float(scales.get(p, 1.0)) for i, p in enumerate(params)}
    if "lam" in at:
        at["lam"] = F.greatest(at["lam"], F.lit(0.0))
    duration = F.greatest(F.lit(1), F.bround(F.element_at(v, k + 1 + len(params)) * day).cast("int")).cast("long")
    return F.struct(largest(F.slice(v, 1, k), kinds).alias("eq_type"), *[c.alias(p) for p, c in at.items()], duration.alias("duration"))


def decoded_value(order: str = "step", keys: Sequence[str] = ("sample_id", "channel"), pad: float = 0.05) -> Column:
    """A window's value from its 13 features and its place p in the sequence: the level, its slopes and curvature in p, drawn to
    the mean, and kept near the window's range. A flat window keeps its level unless that is 0.
    """
    w = Window.partitionBy(*keys)
    p = (F.row_number().over(w.orderBy(order)) - 1) / F.greatest(F.count(F.lit(1)).over(w) - 1, F.lit(1))
    cur, low, high = F.col("current_value"), F.col("min"), F.col("max")
    slope = 0.5 * F.col("delta_1") + 0.3 * F.col("delta_6") / 6 + 0.2 * F.col("delta_24") / 24
    raw = cur + slope * p + 0.5 * F.col("second_diff") * p * (1 - p) + 0.15 * (F.col("mean") - cur)
    near0 = lambda c: F.abs(c) <= 1e-8
    margin = F.greatest(pad * F.abs("range"), F.lit(1e-6))
    bounded = F.least(F.greatest(raw, F.least(low, high) - margin), F.greatest(low, high) + margin)
    flat = near0(F.col("range")) & (F.abs(low - high) <= 1e-8 + 1e-5 * F.abs(high))
    return F.when(flat, F.when(near0(cur), raw).otherwise(cur)).otherwise(bounded)


def time_placeholders(v: Column, channels: Sequence[str]) -> Column:
    """A vector's time block as a struct: whole numbers rounded half to even, lengths at least 1, counts at least 0."""
    at = lambda i: F.element_at(v, i + 1).cast("double")
    whole = lambda i, low: F.greatest(F.bround(at(i)).cast("long"), F.lit(low).cast("long"))
    names = ("mean_inter_event_gap_steps", "var_inter_event_gap_steps", "mean_peak_width_steps", "max_peak_width_steps")
    over = F.map_from_arrays(F.array(*[F.lit(c) for c in channels]), F.array(*[at(8 + i) for i in range(len(channels))]))
    return F.struct(
        at(0).alias("time_step_hours"),
        whole(1, 1).alias("window_length_steps"),
        whole(2, 1).alias("forecast_horizon_steps"),
        *[at(3 + i).alias(n) for i, n in enumerate(names)],
        over.alias("duration_over_threshold_by_channel"),
        F.array_repeat(F.lit(0.0), whole(7, 0).cast("int")).alias("normalized_event_positions"),
    )


def split_vector(v: Column, channels: int, intra: int = 13, inter: int = 5, hazard: int = 13) -> Column:
    """The blocks of a window's vector as arrays: intra and hazard by feature and channel, inter by feature and pair, and the time block.
    A vector of another size is an error.
    """
    pairs = channels * (channels - 1) // 2
    sizes = {"intra": intra * channels, "inter": inter * pairs, "hazard": hazard * channels, "time": 8 + channels}
    v = F.when(F.size(v) == sum(sizes.values()), v).otherwise(F.raise_error(F.concat(F.lit("vector size "), F.size(v).cast("string"))).cast("array<double>"))
    parts, at = [], 1
    for name, size in sizes.items():
        parts.append(F.slice(v, at, size).alias(name))
        at += size
    return F.struct(*parts)


def hazards(block: Column, channels: Sequence[str], names: Sequence[str]) -> Column:
    """An array of (channel, feature, value) of a hazard block, by feature and channel."""
    rows = [F.struct(F.lit(c).alias("channel"), F.lit(n).alias("feature"), F.element_at(block, i * len(channels) + j + 1).alias("value")) for i, n in enumerate(names) for j, c in enumerate(channels)]
    return F.array(*rows)


def decoded_hazards(steps: DataFrame, grid: DataFrame, channels: Sequence[str], names: Sequence[str], block: str = "hazard") -> DataFrame:
    """channel, feature, t, value on the grid (t) from forecast steps (t and a hazard block): on the lines between steps, ends held."""
    each = steps.select(F.col("t").cast("double").alias("t"), F.explode(hazards(F.col(block), channels, names)).alias("h")).select("t", "h.channel", "h.feature", "h.value")
    keys = each.select("channel", "feature").distinct()
    asked = grid.select(F.col("t").cast("double").alias("t")).join(F.broadcast(keys))
    return interpolated(each, asked, "t", "value", ("channel", "feature"))


def interpolated(points: DataFrame, grid: DataFrame, at: str = "t", value: str = "v", keys: Sequence[str] = ()) -> DataFrame:
    """grid with value: on the line between the points about it, and that of the nearest point beyond them."""
    both = points.select(*keys, at, F.col(value).alias("_v")).unionByName(grid.select(*keys, at).withColumn("_v", F.lit(None).cast("double")).withColumn("_g", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    back, ahead = (w.orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc(at), F.desc(at)))
    known = F.when(F.col("_v").isNotNull(), F.col(at))
    t0, t1, v0, v1 = F.max(known).over(back), F.min(known).over(ahead), F.last("_v", True).over(back), F.last("_v", True).over(ahead)
    line = v0 + (v1 - v0) * F.try_divide(F.col(at) - t0, t1 - t0)
    out = both.withColumn(value, F.coalesce(F.when(t0 == t1, v0), line, v0, v1))
    return out.filter("_g = 1").select(*keys, at, value)
