"""One-step predictors, regimes of the best predictor, and windows inside regimes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import Regimes
from tidemark.operators.samples import BUCKET, numbered
from tidemark.operators.signal import KEYS, ordered

#: The predictors in the order that breaks ties.
PREDICTORS = ("level", "velocity", "acceleration", "local_ar2")


def wrapped(x: Column) -> Column:
    return F.pmod(x, F.lit(360.0))


def circular_error(actual: Column, predicted: Column) -> Column:
    """Distance in degrees on the circle."""
    return F.abs(F.pmod(actual - predicted + 180.0, F.lit(360.0)) - 180.0)


def unwrapped(x: Column, keys: Sequence[str] = KEYS) -> Column:
    """Angles with the jumps between neighbours brought into [-180, 180]; null from the first gap on."""
    w = ordered(keys)
    jump = x - F.lag(x).over(w)
    small = F.pmod(jump + 180.0, F.lit(360.0)) - 180.0
    small = F.when((small == -180.0) & (jump > 0), 180.0).otherwise(small)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    missing = F.max(F.when(x.isNull(), 1).otherwise(0)).over(run)
    return F.when(missing == 0, x + F.sum(F.coalesce(small - jump, F.lit(0.0))).over(run))


def one_step(sig: DataFrame, value: str = "s", keys: Sequence[str] = KEYS) -> DataFrame:
    """sig with level, velocity and acceleration predictions of each value from those before it."""
    w = ordered(keys)
    x1, x2, x3 = (F.lag(value, k).over(w) for k in (1, 2, 3))
    return sig.withColumns({"level": x1, "velocity": 2 * x1 - x2, "acceleration": 3 * x1 - 3 * x2 + x3})


def scoreboard(sig: DataFrame, value: str = "s", keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean absolute error of each predictor per channel over the steps where all are known, the best first."""
    out = one_step(sig, value, keys).filter(F.col(value).isNotNull() & F.col("acceleration").isNotNull() & F.col("velocity").isNotNull() & F.col("level").isNotNull())
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("predictor"), F.abs(F.col(value) - F.col(p)).alias("e")) for p in PREDICTORS[:3]]))
    return out.select(*keys, each.alias("p")).groupBy(*keys, F.col("p.predictor").alias("predictor")).agg(F.count(F.lit(1)).alias("n"), F.avg("p.e").alias("mae"))


def board(sig: DataFrame, value: str = "s", fit: int = 24, circular: Sequence[str] = (), least: int = 8, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, predictor, n and mae of the four predictors over each series' known values in order, gaps closed: each predicts every
    value that has enough before it (1, 2, 3 and 3; the last fits an autoregression to the last ``fit`` or fewer). Angles of
    ``circular`` channels are unwrapped first, errors are on the circle. Series of fewer than ``least`` values have no row.
    """
    known = sig.filter(F.col(value).isNotNull() & ~F.isnan(value))
    turn = F.col("channel").isin(*circular) if circular else F.lit(False)
    w = ordered(keys)
    x = F.col(value).cast("double")
    known = known.select(*keys, "idx", F.when(turn, unwrapped(x, keys)).otherwise(x).alias("y"), turn.alias("_turn"))
    known = known.withColumn("past", F.collect_list("y").over(w.rowsBetween(-max(fit, 3), -1))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))

    def predicted(frames):
        for g in frames:
            size = g["past"].map(len).to_numpy()
            guess = np.full((len(g), 4), np.nan)
            for k in np.unique(size):
                at = np.flatnonzero(size == k)
                if not k:
                    continue
                p = np.stack(g["past"].to_numpy()[at]).astype(float)
                guess[at, 0] = p[:, -1]
                if k > 1:
                    guess[at, 1] = 2 * p[:, -1] - p[:, -2]
                if k > 2:
                    guess[at, 2] = 3 * p[:, -1] - 3 * p[:, -2] + p[:, -3]
                    guess[at, 3] = ar2_predictions(p)
            e = np.abs(g["y"].to_numpy(float)[:, None] - guess)
            circle = np.abs((g["y"].to_numpy(float)[:, None] - guess % 360 + 180) % 360 - 180)
            yield g[list(keys)].assign(e=list(np.where(g["_turn"].to_numpy()[:, None], circle, e)))

    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in sig.select(*keys).schema) + "e array<double>"
    errors = known.filter(F.col("_n") >= least).drop("_n", "idx").mapInPandas(predicted, schema)
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("predictor"), F.nanvl(F.col("e")[i], F.lit(None)).alias("e")) for i, p in enumerate(PREDICTORS)]))
    return errors.select(*keys, each.alias("p")).groupBy(*keys, F.col("p.predictor").alias("predictor")).agg(F.count("p.e").alias("n"), F.avg("p.e").alias("mae"))


def top_signatures(labels: DataFrame, blocks: DataFrame, k: int = 12, side: Sequence[str] = ()) -> DataFrame:
    """signature and steps: the k combinations of the channels' labels at the starts of blocks that cover most steps (ties: by signature)."""
    at = blocks.withColumn("idx", F.col("start_idx")).join(labels, [*side, "idx"])
    own = at.groupBy(*side, "block_id", "start_idx", "end_idx").agg(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws("=", "channel", F.coalesce("label", F.lit("none")))))).alias("signature"))
    return own.groupBy("signature").agg(F.sum(F.col("end_idx") - F.col("start_idx") + 1).alias("steps")).orderBy(F.desc("steps"), "signature").limit(k)


def label_shares(labels: DataFrame) -> DataFrame:
    """channel, label, share of the channel's steps (label null: unknown)."""
    n = labels.groupBy("channel", "label").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("channel")))


def ar2_predictions(windows: np.ndarray) -> np.ndarray:
    """The next value of each row by least squares of x[t] on 1, x[t-1], x[t-2]; of least norm where that is not unique."""
    t = windows[:, 2:]
    design = np.stack([np.ones_like(t), windows[:, 1:-1], windows[:, :-2]], axis=2)
    inverse = np.linalg.pinv(design, rcond=np.finfo(float).eps * max(design.shape[1], 3))
    c = np.einsum("nij,nj->ni", inverse, t)
    return c[:, 0] + c[:, 1] * windows[:, -1] + c[:, 2] * windows[:, -2]


def best_labels(x: np.ndarray, history: int, fit: int, circular: bool = False) -> np.ndarray:
    """The number of the best predictor at each step, -1 where the history or the value is not whole."""
    n, h = len(x), max(history, 3)
    out = np.full(n, -1)
    if n <= h:
        return out
    past = np.lib.stride_tricks.sliding_window_view(x, h)[:-1]
    now = x[h:]
    ok = np.isfinite(now) & np.isfinite(past).all(1)
    if not ok.any():
        return out
    p, y = past[ok], now[ok]
    guess = np.stack([p[:, -1], 2 * p[:, -1] - p[:, -2], 3 * p[:, -1] - 3 * p[:, -2] + p[:, -3], ar2_predictions(p[:, -max(fit, 3) :])])
    e = np.abs((y % 360 - guess % 360 + 180) % 360 - 180) if circular else np.abs(y - guess)
    out[h:][ok] = e.argmin(0)
    return out


def without_short_runs(labels: np.ndarray, least: int) -> np.ndarray:
    """Give each run shorter than ``least`` the label of its left neighbour, or of its right one where the left has none;
    always the first such run, until none is left that can change. Runs of -1 stay.
    """
    # runs as [label, length]; a run that takes its left neighbour's label melts into it, so work resumes there
    cut = np.flatnonzero(np.diff(labels)) + 1
    runs = [[int(labels[a]), int(b - a)] for a, b in zip([0, *cut], [*cut, len(labels)], strict=True)] if len(labels) else []
    i = 0
    while i < len(runs):
        label, size = runs[i]
        if label == -1 or size >= least:
            i += 1
            continue
        left = runs[i - 1][0] if i else -1
        right = runs[i + 1][0] if i + 1 < len(runs) else -1
        new = left if left != -1 else right
        if new == -1:
            i += 1
            continue
        runs[i][0] = new
        if i + 1 < len(runs) and runs[i + 1][0] == new:
            runs[i][1] += runs.pop(i + 1)[1]
        if i and runs[i - 1][0] == new:
            runs[i - 1][1] += runs.pop(i)[1]
            i -= 1
    return np.concatenate([np.full(n, v) for v, n in runs]) if runs else labels


def merged_ranges(ranges: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Join each range shorter than ``least`` to the one before it, the first to the one after it."""
    out: list[list[int]] = [list(r) for r in ranges]
    i = 0
    while i < len(out) and len(out) > 1:
        if out[i][1] - out[i][0] + 1 >= least:
            i += 1
        elif i == 0:
            out[1][0] = out[0][0]
            del out[0]
        else:
            out[i - 1][1] = out[i][1]
            del out[i]
            i -= 1
    return [tuple(r) for r in out]


def filled(df: DataFrame, keys: Sequence[str], columns: dict[str, tuple[Column, bool]], order: str = "pos") -> DataFrame:
    """df with, by name, the last value of a column that isn't null at or before each row (or, if False, the next at or after it).

    Rows are read in order within their _bucket only; of each bucket one row, its last and next values, is ordered across buckets.
    """
    own = {True: Window.partitionBy(*keys, "_bucket").orderBy(order), False: Window.partitionBy(*keys, "_bucket").orderBy(F.desc(order))}
    across = {True: Window.partitionBy(*keys).orderBy("_bucket"), False: Window.partitionBy(*keys).orderBy(F.desc("_bucket"))}
    ends = [(F.max if back else F.min)(F.when(c.isNotNull(), F.struct(order, c.alias("v")))).alias(f"_end_{name}") for name, (c, back) in columns.items()]
    carry = df.groupBy(*keys, "_bucket").agg(*ends)
    carry = carry.select(*keys, "_bucket", *[F.last(f"_end_{name}", True).over(across[back].rowsBetween(Window.unboundedPreceding, -1))["v"].alias(f"_carry_{name}") for name, (_, back) in columns.items()])
    near = df.withColumns({name: F.last(c, True).over(own[back].rowsBetween(Window.unboundedPreceding, 0)) for name, (c, back) in columns.items()})
    out = near.join(carry, [*keys, "_bucket"])
    return out.withColumns({name: F.coalesce(name, f"_carry_{name}") for name in columns}).drop(*[f"_carry_{name}" for name in columns])


def smoothed_runs(rows: DataFrame, least: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """rows (keys, pos, _bucket, raw: a label's number or -1, was and next: those of the rows before and after, null at the ends) with
    label: what without_short_runs() makes of raw.

    Of a stretch without -1, the first rows, up to the end of the run that holds the least-th of them, take that run's label. A later
    run that is long enough keeps its label; a short one takes that of the last one that did. So labels follow from where runs and
    stretches begin and end, which is carried along the rows, and no task reads a whole series.
    """
    pos, raw = F.col("pos"), F.col("raw")
    begins = F.col("was").isNull() | (F.col("was") != raw)
    ends = F.col("next").isNull() | (F.col("next") != raw)
    first = (raw >= 0) & (F.col("was").isNull() | (F.col("was") < 0))
    last = (raw >= 0) & (F.col("next").isNull() | (F.col("next") < 0))
    out = filled(rows, keys, {"_run": (F.when(begins, pos), True), "_end": (F.when(ends, pos), False), "_from": (F.when(first, pos), True), "_to": (F.when(last, pos), False)})
    place = F.least(F.col("_from") + least - 1, F.col("_to"))
    head = F.when((raw >= 0) & (pos == place), F.struct("raw", F.col("_end").alias("end")))
    out = filled(out, keys, {"_head": (head, True), "_ahead": (head, False)})
    out = out.withColumn("_head", F.when(pos < place, F.col("_ahead")).otherwise(F.col("_head")))
    keeps = (raw >= 0) & (pos == F.col("_run")) & (F.col("_end") - F.col("_run") + 1 >= least) & (pos > F.col("_head.end"))
    out = filled(out, keys, {"_kept": (F.when(keeps, F.struct("pos", "raw")), True)})
    later = (pos > F.col("_head.end")) & (F.col("_kept.pos") > F.col("_head.end"))
    label = F.when(raw < 0, raw).when(later, F.col("_kept.raw")).otherwise(F.col("_head.raw"))
    return out.withColumn("label", label).drop("_run", "_end", "_from", "_to", "_head", "_ahead", "_kept")


def raw_labels(sig: DataFrame, config: Regimes = Regimes(), circular: Sequence[str] = (), keys: Sequence[str] = KEYS, bucket: int = BUCKET) -> DataFrame:
    """keys, idx, pos, _bucket, raw, was, next: the number of the best predictor of each row and of its neighbours, -1 where unknown. Each
    range of ``bucket`` rows is labelled by itself, with the rows before it that a history needs.
    """
    h = max(config.history, 3)
    if bucket <= h:
        raise ValueError(f"a range must be longer than the history of {h}")
    at = numbered(sig.select(*keys, "idx", "s"), "idx", tuple(keys))
    if circular:  # angles are unknown from their first gap on
        gap = at.filter(F.col("s").isNull() | F.isnan("s")).groupBy(*keys).agg(F.min("pos").alias("_gap"))
        at = at.join(gap, list(keys), "left").withColumn("s", F.when(F.col("_gap").isNull() | (F.col("pos") < F.col("_gap")) | ~F.col("channel").isin(*circular), F.col("s"))).drop("_gap")
    own, place = F.floor(F.col("pos") / bucket), F.col("pos") % bucket
    ranges = F.array_compact(F.array(own, F.when(place >= bucket - h - 1, own + 1), F.when((place == 0) & (own > 0), own - 1)))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        x = g["s"].to_numpy(float)
        turn = "channel" in g and g["channel"].iloc[0] in circular
        labels = best_labels(np.unwrap(x, period=360) if turn else x, config.history, config.fit, turn)
        pos = g["pos"].to_numpy()
        out = g[[*keys, "idx", "pos", "_bucket"]].assign(raw=labels, was=pd.array([None, *labels[:-1]], "Int64"), next=pd.array([*labels[1:], None], "Int64"))
        return out[pos // bucket == g["_bucket"].to_numpy()]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sig.select(*keys, "idx").schema) + ", pos long, _bucket long, raw int, was int, next int"
    return at.withColumn("_bucket", F.explode(ranges)).groupBy(*keys, "_bucket").applyInPandas(run, schema)


def labelled(sig: DataFrame, config: Regimes = Regimes(), circular: Sequence[str] = (), keys: Sequence[str] = KEYS, bucket: int = BUCKET) -> DataFrame:
    """keys, idx and the smoothed label of the best predictor (null if unknown). A long series is as many tasks as it has ranges of
    ``bucket`` rows; the raw labels are written once, as the smoothing reads them several times.
    """
    from tidemark.sources.sinks import fresh_path, write_table

    path = fresh_path(sig.sparkSession)
    write_table(raw_labels(sig, config, circular, keys, bucket), path)
    out = smoothed_runs(sig.sparkSession.read.parquet(path), config.min_run, keys)
    names = F.array(*[F.lit(p) for p in PREDICTORS])
    return out.select(*keys, "idx", F.when(F.col("label") >= 0, F.get(names, F.col("label"))).alias("label"))


def switch_counts(labels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per step, the channels whose label differs from that of the step before, both known."""
    side = [k for k in keys if k != "channel"]
    changed = labels.withColumn("was", F.lag("label").over(ordered(keys)))
    return changed.groupBy(*side, "idx").agg(F.sum(F.when(F.col("label") != F.col("was"), 1).otherwise(0)).alias("n_changed"))


def regimes(labels: DataFrame, config: Regimes = Regimes(), keys: Sequence[str] = KEYS) -> DataFrame:
    """Regime blocks: block_id, start_idx, end_idx (and the series keys). A block starts where enough channels switch at once;
    short blocks join their neighbours. Only the boundaries of a series reach one group.
    """
    side = [k for k in keys if k != "channel"]
    h = max(config.history, 3)
    counts = switch_counts(labels, keys)
    ends = counts.groupBy(*side).agg((F.max("idx") + 1).alias("n"), F.sort_array(F.collect_list(F.when((F.col("n_changed") >= config.min_changed) & (F.col("idx") > h), F.col("idx")))).alias("cuts"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in g.to_dict("records"):
            if r["n"] > h + 1:
                b = sorted({h, *map(int, r["cuts"]), int(r["n"])})
                for i, (a, z) in enumerate(merged_ranges([(x, y - 1) for x, y in zip(b, b[1:], strict=False)], config.min_length)):
                    rows.append([r[k] for k in side] + [i, a, z])
        return pd.DataFrame(rows, columns=[*side, "block_id", "start_idx", "end_idx"])

    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in labels.select(*side).schema) + "block_id long, start_idx long, end_idx long"
    return ends.mapInPandas(lambda frames: (run(g) for g in frames), schema)


def windows_in_blocks(blocks: DataFrame, length: int = 24, stride: int = 1) -> DataFrame:
    """Every window that lies wholly in a block: the series, block_id, start_idx, end_idx."""
    side = [c for c in blocks.columns if c not in ("block_id", "start_idx", "end_idx")]
    fits = blocks.filter(F.col("end_idx") - F.col("start_idx") + 1 >= length)
    out = fits.select(*side, "block_id", F.explode(F.sequence(F.col("start_idx"), F.col("end_idx") - length + 1, F.lit(stride).cast("long"))).alias("start_idx"))
    return out.withColumn("end_idx", F.col("start_idx") + length - 1)
