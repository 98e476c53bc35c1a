"""Scale-free features of windows, and vectors of fitted dynamics: projections of other operators' tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.equations import DYNAMICS

#: The scaled features by what divides them: the channel's range, its square, the window's length, range * events, range * length.
BY_RANGE = ("delta_1", "delta_6", "delta_24", "second_diff", "max_peak_value", "mean_prominence", "max_prominence", "max_rise_slope")
BY_RANGE2 = ("variance",)
BY_LENGTH = ("extrema_count", "n_peaks", "mean_width", "max_width", "duration_over")
BY_RANGE_EVENTS = ("extrema_amplitude_sum",)
BY_RANGE_LENGTH = ("upper_tail", "lower_tail", "cumulative_risk")
AS_THEY_ARE = ("hazard_flag", "compound_flag")
SCALED = BY_RANGE + BY_RANGE2 + BY_LENGTH + BY_RANGE_EVENTS + BY_RANGE_LENGTH + AS_THEY_ARE


def scaled_features(intra: DataFrame, hazard: DataFrame, length: int = 24) -> DataFrame:
    """window_id, channel and SCALED: features of windows that don't depend on a channel's unit. A range of almost 0 counts as 1."""
    both = intra.join(hazard, ["window_id", "channel"])
    total = both.groupBy("window_id").agg(F.greatest(F.sum("extrema_count"), F.lit(1.0)).alias("_events"))
    scale = F.when(F.abs("range") > 1e-6, F.abs("range")).otherwise(1.0)
    cols = {c: F.col(c) / scale for c in BY_RANGE}
    cols |= {c: F.col(c) / (scale * scale) for c in BY_RANGE2} | {c: F.col(c) / length for c in BY_LENGTH}
    cols |= {c: F.col(c) / (scale * F.col("_events")) for c in BY_RANGE_EVENTS} | {c: F.col(c) / (scale * length) for c in BY_RANGE_LENGTH}
    cols |= {c: F.col(c) for c in AS_THEY_ARE}
    return both.join(total, "window_id").select("window_id", "channel", *[cols[c].alias(c) for c in SCALED])


def scaled_pairs(inter: DataFrame, sync: DataFrame, length: int = 24) -> DataFrame:
    """window_id, a_ch, b_ch and the pairs' features: correlations as they are, tanh of the slope ratio, counts and lags by length."""
    by = ["window_id", "a_ch", "b_ch"]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = inter.join(sync, by, "left")
    return out.select(*by, "correlation", "lag_correlation", F.tanh("slope_ratio").alias("slope_ratio"), (zero("sync_count") / length).alias("sync_count"), (zero("mean_event_lag") / length).alias("mean_event_lag"))


def resampled(values: Column, size: int = 8) -> Column:
    """An array at ``size`` evenly spaced places, on the lines between its entries; zeros for an empty one."""
    n = F.size(values)

    def at(k: Column) -> Column:
        x = k * (n - 1) / F.lit(max(size - 1, 1))
        i = F.least(F.floor(x).cast("int"), F.greatest(n - 2, F.lit(0)))
        a, b = F.try_element_at(values, i + 1), F.try_element_at(values, F.least(i + 2, n))
        return a + (b - a) * (x - i)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at)).otherwise(F.array_repeat(F.lit(0.0), size))


PARAMS = ("L", "c", "lam", "omega", "A", "B")


def dynamics_vector(kind: Column, params: Sequence[str] = PARAMS) -> Column:
    """One-hot kind and parameters of a channel's dynamics."""
    return F.array(*[F.when(kind == k, 1.0).otherwise(0.0) for k in DYNAMICS], *[F.col(p).cast("double") for p in params])


def dynamics_of(v: Column) -> Column:
    """The dynamics that a vector stands for; the first kind on a tie."""
    k = len(DYNAMICS)
    kind = F.element_at(F.array(*[F.lit(x) for x in DYNAMICS]), F.array_position(F.slice(v, 1, k), F.array_max(F.slice(v, 1, k))).cast("int"))
    return F.struct(kind.alias("kind"), *[F.element_at(v, k + 1 + i).alias(p) for i, p in enumerate(PARAMS)])


def dynamics_at(d: Column, t: Column, x0: Column | float = 0.0) -> Column:
    """The standardised value of a dynamics (a struct with kind and PARAMS) at step t from standardised start x0."""
    x0 = x0 if isinstance(x0, Column) else F.lit(float(x0))
    wave = d["A"] * F.cos(d["omega"] * t) + d["B"] * F.sin(d["omega"] * t)
    fade = F.exp(-d["lam"] * t)
    return F.when(d["kind"] == "level", d["L"]).when(d["kind"] == "linear", x0 + d["c"] * t).when(d["kind"] == "exponential", d["L"] + (x0 - d["L"]) * fade).otherwise(d["L"] + fade * wave)


def forward(d: Column, x0: Column, std: Column, steps: int) -> Column:
    """Values of the next steps, anchored at x0: x0 + std * dynamics(1, 2 ...)."""
    scale = F.when(std > 1e-8, std).otherwise(1.0)
    return F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda t: x0 + scale * dynamics_at(d, t.cast("double")))


def chained(patterns: Column, x0: Column, std: Column) -> Column:
    """Values of a sequence (array of dynamics), each one step on from where the one before it ended."""
    scale = F.when(std > 1e-8, std).otherwise(1.0)
    fold = F.aggregate(patterns, F.array(x0.cast("double")), lambda acc, d: F.concat(acc, F.array(F.element_at(acc, -1) + scale * dynamics_at(d, F.lit(1.0)))))
    return F.slice(fold, 2, F.greatest(F.size(fold) - 1, F.lit(0)))


def functional_vectors(pieces: DataFrame, points: int = 100) -> DataFrame:
    """segment_id, v: all channels' dynamics at ``points`` places of [0, 1], weighted so that squared distances between vectors
    are the integrals of squared differences (trapezoid rule), and the synchrony. Channels in their order.
    """
    d = F.struct("kind", *PARAMS)
    step = 1.0 / (points - 1)
    weight = lambda k: F.when((k == 0) | (k == points - 1), math.sqrt(step / 2)).otherwise(math.sqrt(step))
    sampled = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: dynamics_at(F.col("_d"), k * step) * weight(k))
    rows = pieces.withColumn("_d", d).select("segment_id", "synchrony", F.struct("channel", sampled.alias("v")).alias("p"))
    out = rows.groupBy("segment_id").agg(F.array_sort(F.collect_list("p")).alias("ps"), F.max("synchrony").cast("double").alias("s"))
    return out.select("segment_id", F.concat(F.flatten(F.transform("ps", lambda p: p["v"])), F.array("s")).alias("v"))
