"""Features of pairs of channels within sliding windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.events import with_extrema
from tidemark.operators.signal import KEYS, series_keys
from tidemark.operators.windows import starts

EPS = 1e-12


def pairs_of(sig: DataFrame, channels: Sequence[str]) -> DataFrame:
    """(the series, a_ch, b_ch, idx, a_s, b_s, a_d1, b_d1) for each pair of channels in their order.

    A step's channels are few: one row per step holds them, and is exploded into its pairs.
    """
    side = series_keys(sig)
    by_step = sig.groupBy(*side, "idx").agg(F.map_from_entries(F.collect_list(F.struct("channel", F.struct("s", "d1")))).alias("m"))
    pairs = [(a, b) for i, a in enumerate(channels) for b in channels[i + 1 :]]
    both = F.array(*[F.struct(F.lit(a).alias("a_ch"), F.lit(b).alias("b_ch"), F.try_element_at("m", F.lit(a)).alias("a"), F.try_element_at("m", F.lit(b)).alias("b")) for a, b in pairs])
    out = by_step.select(*side, "idx", F.explode(both).alias("p"))
    return out.select(*side, "p.a_ch", "p.b_ch", "idx", F.col("p.a.s").alias("a_s"), F.col("p.b.s").alias("b_s"), F.col("p.a.d1").alias("a_d1"), F.col("p.b.d1").alias("b_d1"))


PAIR = ("a_ch", "b_ch")


def _corr(a: Column, b: Column, f) -> Column:
    """Correlation of the rows in a frame where both are there; 0 for fewer than two of them or none that vary."""
    ok = a.isNotNull() & b.isNotNull()
    a, b = F.when(ok, a), F.when(ok, b)
    n = F.count(a).over(f).cast("double")
    sa, sb, saa, sbb, sab = (F.sum(c).over(f) for c in (a, b, a * a, b * b, a * b))
    va, vb, cab = saa - sa * sa / n, sbb - sb * sb / n, sab - sa * sb / n
    return F.when((n < 2) | (va <= EPS) | (vb <= EPS), 0.0).otherwise(F.coalesce(F.try_divide(cab, F.sqrt(va * vb)), F.lit(0.0)))


def correlations(pairs: DataFrame, length: int = 24, stride: int = 1, max_lag: int = 6) -> DataFrame:
    """correlation, lag_correlation (of lags 0, +1, -1, +2 ... that of greatest size; the earlier on a tie) and slope_ratio.

    Sums over shifted columns and shorter frames of one sort: no row is repeated for a lag.
    """
    keys = (*series_keys(pairs), *PAIR)
    w = Window.partitionBy(*keys).orderBy("idx")
    f = w.rowsBetween(0, length - 1)
    a, b = F.col("a_s"), F.col("b_s")
    cols = {"_r0": F.round(_corr(a, b, f), 9)}
    shifted = {f"_b{k}": F.lag("b_s", k).over(w) for k in range(1, max_lag + 1)} | {f"_a{k}": F.lag("a_s", k).over(w) for k in range(1, max_lag + 1)}
    out = pairs.withColumns(shifted)
    for lag in range(1, max_lag + 1):
        g = w.rowsBetween(lag, length - 1)
        cols[f"_p{lag}"] = F.round(_corr(a, F.col(f"_b{lag}"), g), 9)
        cols[f"_m{lag}"] = F.round(_corr(F.col(f"_a{lag}"), b, g), 9)
    ma, mb = F.avg(F.abs("a_d1")).over(f), F.avg(F.abs("b_d1")).over(f)
    cols["slope_ratio"] = F.coalesce(F.try_divide(ma, F.when(mb != 0, mb)), F.lit(0.0))
    out = out.withColumns(cols)
    best = F.col("_r0")
    for lag in range(1, max_lag + 1):
        for name in (f"_p{lag}", f"_m{lag}"):
            best = F.when(F.abs(F.col(name)) > F.abs(best), F.col(name)).otherwise(best)
        out = out.withColumn(f"_best{lag}", best)
        best = F.col(f"_best{lag}")
    out = out.withColumn("correlation", F.col("_r0")).withColumn("lag_correlation", best)
    return starts(out, length, stride, keys).select("window_id", *keys, "correlation", "lag_correlation", "slope_ratio")


def synchronous(sig: DataFrame, n_steps: int, length: int = 24, stride: int = 1, tolerance: int = 1) -> DataFrame:
    """Per window and pair: events of the earlier channel with one of the later channel near, and the mean distance.

    Each event of a later channel is exploded to the steps within the tolerance; the join is on the step.
    """
    from tidemark.operators.windows import event_bridge

    side = series_keys(sig)
    own = [*side, "window_id"]
    ev = with_extrema(sig, (*side, *KEYS)).filter("ext_sign is not null").select(*side, "channel", "idx")
    left = event_bridge(ev, n_steps, length, stride).select(*own, F.col("channel").alias("a_ch"), "idx")
    near = event_bridge(ev, n_steps, length, stride).select(*own, F.col("channel").alias("b_ch"), F.col("idx").alias("at"))
    near = near.withColumn("idx", F.explode(F.sequence(F.col("at") - tolerance, F.col("at") + tolerance)))
    hit = left.join(near, [*own, "idx"]).filter("a_ch < b_ch").groupBy(*own, "a_ch", "b_ch", "idx").agg(F.min(F.abs(F.col("idx") - F.col("at"))).alias("lag"))
    return hit.groupBy(*own, "a_ch", "b_ch").agg(F.count(F.lit(1)).alias("sync_count"), F.avg("lag").alias("mean_event_lag"))
