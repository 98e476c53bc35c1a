"""Equation segments of series: walk-forward segmentation, joint refits, evaluation, decoding.

A walk depends on all steps before it, so a channel of a series is one group; channels and series run
in parallel. Refits of the pieces of a joint grid are independent of one another and run in parallel each.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.equations import DYN, FIT, HARMONIC_SET, PLAIN_SET, Walk, best_fit, dynamics_value, fit_dynamics, value_at
from tidemark.operators.samples import numbered
from tidemark.operators.signal import KEYS, series_keys

SEGMENT = "segment_id long, start_idx long, end_idx long, duration long, x0 double, " + FIT


def walk(y: np.ndarray, tolerance: float, first: int = 24, kinds: dict[str, int] = HARMONIC_SET, fastest: float = 10.0) -> list[tuple]:
    """(start, end, fit) of each segment of a whole series."""
    return Walk(tolerance, first, kinds, fastest).feed(y, last=True)


def segmented(series: DataFrame, tolerance: float = 1.0, harmonic: bool = True, value: str = "x", keys: Sequence[str] = KEYS, first: int = 24) -> DataFrame:
    """keys and SEGMENT columns. duration counts points. Nulls never end a segment."""
    kinds, fastest = (HARMONIC_SET, 10.0) if harmonic else (PLAIN_SET, 5.0)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        y, idx = g[value].to_numpy(float), g["idx"].to_numpy()
        rows = [(i, idx[a], idx[z], z - a + 1, y[a], f.eq_type, f.L, f.c, f.lam, f.A, f.B, f.rms, f.n_points) for i, (a, z, f) in enumerate(walk(y, tolerance, first, kinds, fastest))]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in SEGMENT.split(", ")])
        for k in keys:
            out[k] = g[k].iloc[0]
        return out

    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in series.select(*keys).schema) + SEGMENT
    return series.select(*keys, "idx", value).groupBy(*keys).applyInPandas(run, schema)


def pieces_between(cuts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """cuts (keys, start_idx, each once in its series) with segment_id, their number, and end_idx, the next cut (null for the last)."""
    at = numbered(cuts, "start_idx", tuple(keys), "segment_id")
    after = at.select(*keys, (F.col("segment_id") - 1).alias("segment_id"), F.col("start_idx").alias("end_idx"))
    return at.join(after, [*keys, "segment_id"], "left")


def joint_refit(boundaries: DataFrame, series: DataFrame, value: str = "x", harmonic: Sequence[str] = (), bucket: int = 64) -> DataFrame:
    """The series, segment_id, start_idx, duration, channel, x0 and a fit for each channel on each piece between boundaries (idx) of the
    series, both ends included. Pieces are exploded into buckets of steps for the join with the series; the groups are the pieces.
    """
    side = list(series_keys(boundaries, series))
    pieces = pieces_between(boundaries.select(*side, F.col("idx").alias("start_idx")).distinct(), side).filter("end_idx > start_idx")
    spread = pieces.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_idx") / bucket), F.floor(F.col("end_idx") / bucket))))
    points = series.select(*side, "channel", "idx", F.col(value).alias("v")).withColumn("_b", F.floor(F.col("idx") / bucket))
    inside = points.join(spread, [*side, "_b"]).filter(F.col("idx").between(F.col("start_idx"), F.col("end_idx")))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        y = g["v"].to_numpy(float)
        channel, start = g["channel"].iloc[0], int(g["start_idx"].iloc[0])
        first = y[0] if g["idx"].iloc[0] == start and np.isfinite(y[0]) else 0.0
        f = best_fit(y[np.isfinite(y)], HARMONIC_SET if channel in harmonic else PLAIN_SET, 10.0 if channel in harmonic else 5.0)
        row = (*[g[k].iloc[0] for k in side], g["segment_id"].iloc[0], start, int(g["end_idx"].iloc[0]) - start, channel, first, f.eq_type, f.L, f.c, f.lam, f.A, f.B, f.rms, f.n_points)
        return pd.DataFrame([row], columns=[*side, "segment_id", "start_idx", "duration", "channel", "x0", *[c.split()[0] for c in FIT.split(", ")]])

    types = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in series.select(*side).schema)
    return inside.groupBy(*side, "segment_id", "channel").applyInPandas(run, types + "segment_id long, start_idx long, duration long, channel string, x0 double, " + FIT)


def evaluated(segments: DataFrame, series: DataFrame, value: str = "x", keys: Sequence[str] = KEYS, bucket: int = 64) -> DataFrame:
    """keys, idx, segment_id, the value and the fitted value of every step in a segment."""
    s = segments.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_idx") / bucket), F.floor(F.col("end_idx") / bucket))))
    p = series.select(*keys, "idx", F.col(value).alias("actual")).withColumn("_b", F.floor(F.col("idx") / bucket))
    both = p.join(s, [*keys, "_b"]).filter(F.col("idx").between(F.col("start_idx"), F.col("end_idx")))
    fit = F.struct("eq_type", "L", "c", "lam", "A", "B")
    return both.withColumn("_f", fit).select(*keys, "idx", "segment_id", "actual", value_at(F.col("_f"), (F.col("idx") - F.col("start_idx")).cast("double")).alias("fitted"))


def extrapolated(segments: DataFrame, steps: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, idx, prediction: the last segment's equation carried on."""
    w = Window.partitionBy(*keys).orderBy(F.desc("start_idx"))
    last = segments.withColumn("_r", F.row_number().over(w)).filter("_r = 1").withColumn("_f", F.struct("eq_type", "L", "c", "lam", "A", "B"))
    out = last.withColumn("idx", F.explode(F.sequence(F.col("end_idx") + 1, F.col("end_idx") + steps)))
    return out.select(*keys, "idx", value_at(F.col("_f"), (F.col("idx") - F.col("start_idx")).cast("double")).alias("prediction"))


def linear_fits(series: DataFrame, block: int, value: str = "x", keys: Sequence[str] = KEYS) -> DataFrame:
    """Constant and linear fits of blocks of steps by aggregates alone: keys, block, n, mean, intercept, slope."""
    t, y = (F.col("idx") % block).cast("double"), F.col(value)
    out = series.filter(y.isNotNull()).withColumn("block", F.floor(F.col("idx") / block)).groupBy(*keys, "block")
    out = out.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), F.var_pop(t).alias("_v"), F.covar_pop(t, y).alias("_c"), F.avg(t).alias("_t"))
    slope = F.when(F.col("_v") > 0, F.col("_c") / F.when(F.col("_v") > 0, F.col("_v"))).otherwise(0.0)
    return out.withColumn("slope", slope).select(*keys, "block", "n", "mean", (F.col("mean") - F.col("slope") * F.col("_t")).alias("intercept"), "slope")


def decoded(segments: DataFrame, x0: float, steps: int, at_least: float | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, idx and value of segments in a chain: each is shifted to begin at the value where the one before it ended.

    The shifts are running sums of f(duration - 1) - f(0). With a floor they aren't, and a group is folded instead.
    """
    f = F.struct("eq_type", "L", "c", "lam", "A", "B")
    if at_least is None:
        w = Window.partitionBy(*keys).orderBy("segment_id")
        s = segments.withColumn("_f", f).withColumn("_a", value_at(F.col("_f"), F.lit(0.0))).withColumn("_z", value_at(F.col("_f"), (F.col("duration") - 1).cast("double")))
        run = w.rowsBetween(Window.unboundedPreceding, -1)
        s = s.withColumn("_carry", F.lit(float(x0)) + F.coalesce(F.sum(F.col("_z") - F.col("_a")).over(run), F.lit(0.0))).withColumn("_from", F.coalesce(F.sum("duration").over(run), F.lit(0)))
        s = s.filter(F.col("_from") < steps).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("duration") - 1)))
        s = s.withColumn("idx", F.col("_from") + F.col("_k")).filter(F.col("idx") < steps)
        return s.select(*keys, "idx", (value_at(F.col("_f"), F.col("_k").cast("double")) + F.col("_carry") - F.col("_a")).alias("value"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        from tidemark.functions.equations import Fit

        now, values = x0, []
        for r in g.sort_values("segment_id").to_dict("records"):
            fit = Fit(*(r[k] for k in ("eq_type", "L", "c", "lam", "A", "B")))
            v = np.maximum(fit.at(np.arange(r["duration"])) + now - float(fit.at(0.0)), at_least)
            values += v[: steps - len(values)].tolist()
            now = float(v[-1])
            if len(values) >= steps:
                break
        return pd.DataFrame({**{k: g[k].iloc[0] for k in keys}, "idx": np.arange(len(values)), "value": values})

    schema = "".join(f"{x.name} {x.dataType.simpleString()}, " for x in segments.select(*keys).schema) + "idx long, value double"
    return segments.groupBy(*keys).applyInPandas(run, schema)


def dynamics_boundaries(series: DataFrame, tolerance: float = 2.4, least: int = 6, value: str = "s", keys: Sequence[str] = KEYS) -> DataFrame:
    """keys and start_idx of each piece: dynamics are fitted on all that remains of the series, and a piece ends at the
    first step after ``least`` that misses them by more than tolerance times their deviation.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        y, start, cuts = g[value].to_numpy(float), 0, [0]
        while start < len(y):
            rest = y[start:]
            d = fit_dynamics(rest)
            scale, ok = (d["std"] if d["std"] > 1e-8 else 1.0), np.isfinite(rest)
            mean = float(rest[ok].mean()) if ok.any() else 0.0
            x0 = (rest[0] - mean) / scale if ok[0] else 0.0
            off = np.abs(rest - (dynamics_value(d, np.arange(len(rest)), x0) * scale + mean)) > tolerance * scale
            off[:least] = False
            if not off.any():
                break
            start += int(np.argmax(off))
            cuts.append(start)
        return pd.DataFrame({**{k: g[k].iloc[0] for k in keys}, "start_idx": g["idx"].to_numpy()[cuts]})

    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in series.select(*keys).schema) + "start_idx long"
    return series.select(*keys, "idx", value).groupBy(*keys).applyInPandas(run, schema)


def dynamics_fits(series: DataFrame, cuts: DataFrame, value: str = "s", bucket: int = 64) -> DataFrame:
    """Per piece of the union of all channels' cuts (start_idx) in a series and channel: DYN columns, and synchrony, the channels that
    cut there.
    """
    side = list(series_keys(series, cuts))
    last = series.groupBy(*side).agg(F.max("idx").alias("last"))
    union = cuts.groupBy(*side, "start_idx").agg(F.count(F.lit(1)).alias("synchrony"))
    pieces = pieces_between(union, side).withColumn("end_idx", F.col("end_idx") - 1)
    pieces = pieces.join(last, side) if side else pieces.join(F.broadcast(last))  # one row without series
    pieces = pieces.withColumn("end_idx", F.coalesce("end_idx", "last")).drop("last")
    spread = pieces.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_idx") / bucket), F.floor(F.col("end_idx") / bucket))))
    points = series.select(*side, "channel", "idx", F.col(value).alias("v")).withColumn("_b", F.floor(F.col("idx") / bucket))
    inside = points.join(spread, [*side, "_b"]).filter(F.col("idx").between(F.col("start_idx"), F.col("end_idx")))
    names = [c.split()[0] for c in DYN.split(", ")]
    whole = [*side, "segment_id", "start_idx", "end_idx", "synchrony", "channel"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        d = fit_dynamics(g["v"].to_numpy(float))
        return pd.DataFrame([[g[k].iloc[0] for k in whole] + [d[k] for k in names]], columns=[*whole, *names])

    types = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in series.select(*side).schema)
    return inside.groupBy(*side, "segment_id", "channel").applyInPandas(run, types + "segment_id long, start_idx long, end_idx long, synchrony long, channel string, " + DYN)
