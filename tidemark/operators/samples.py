"""Sequence samples: history and target windows, splits, and forecast tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.signal import series_keys


def target_count(strategy: str = "extrema", horizon: int = 24, stride: int = 1, min_length: int = 6, explicit: int | None = None) -> int:
    """How many target windows a sample has."""
    if explicit is not None:
        return max(explicit, 1)
    if strategy == "new_physics":
        return 3
    step = min_length if strategy == "predictor" else stride
    return max(1, -(-horizon // max(step, 1)))


#: Steps of an order column that make up one bucket of a series without keys.
BUCKET = 65_536


def numbered(df: DataFrame, by: str = "start_idx", keys: tuple[str, ...] = (), name: str = "pos") -> DataFrame:
    """df with each row's place from 0 in the order of ``by`` (a number; ties: any order). Rows whose ``by`` is null have no place
    and are left out.

    Rows are numbered inside buckets of ``by``; a bucket's first number is the rows of the buckets before it, of which there are
    few. So no task sees a whole series.
    """
    df = df.filter(F.col(by).isNotNull())
    bucket = F.floor(F.col(by) / BUCKET)
    own = Window.partitionBy(*keys, "_bucket").orderBy(by)
    out = df.withColumn("_bucket", bucket).withColumn("_own", F.row_number().over(own).cast("long") - 1)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return out.join(counts, [*keys, "_bucket"]).withColumn(name, F.col("_own") + F.col("_first")).drop("_bucket", "_own", "_first")


def history_frames(windows: DataFrame, history: int = 4, by: str = "start_idx") -> DataFrame:
    """windows with history_ids, the ids of the last ``history`` windows, this one last; only whole histories.

    Each window sends its id to the places of those whose history it is in; the join is on the place.
    """
    keys = series_keys(windows)
    at = numbered(windows, by, keys)
    sent = at.select(*keys, F.explode(F.sequence(F.col("pos"), F.col("pos") + history - 1)).alias("pos"), F.struct(F.col("pos").alias("own"), "window_id").alias("w"))
    frames = sent.groupBy(*keys, "pos").agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["window_id"]).alias("history_ids"))
    return at.join(frames.filter(F.size("history_ids") == history), [*keys, "pos"]).drop("pos")


def targets_at_offsets(windows: DataFrame, horizon: int = 24, stride: int = 1, count: int = 24) -> DataFrame:
    """window_id (and the series) and target_ids: the windows of the series that start horizon, horizon + stride ... steps later, if
    all of them exist.

    Each window asks for its targets' starts; the join is on the start.
    """
    keys = series_keys(windows)
    asked = windows.select(*keys, "window_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.col("start_idx") + horizon + k * stride)).alias("k", "start_idx"))
    found = asked.join(windows.select(*keys, "start_idx", F.col("window_id").alias("target_id")), [*keys, "start_idx"])
    ids = found.groupBy(*keys, "window_id").agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "target_id"))), lambda v: v["target_id"]).alias("target_ids"))
    return ids.filter(F.col("n") == count).drop("n")


def forward_asof(left: DataFrame, right: DataFrame, at: str = "at", time: str = "start_idx", what: str = "pos", by: tuple[str, ...] = ()) -> DataFrame:
    """left with ``what`` of the first row of right whose ``time`` is at or after ``at``; null if there is none.

    Both sides go in one sorted stream for each key of ``by`` and bucket of the time (a number), and the next right row is read
    off it from its end: no range join. Where a bucket has none left, the first row of the next bucket that has one is it.
    """
    name = what if what not in left.columns else f"{what}_right"
    both = left.withColumn("_t", F.col(at)).withColumn("_r", F.lit(0)).withColumn("_w", F.lit(None).cast(right.schema[what].dataType))
    other = right.select(*by, F.col(time).alias("_t"), F.lit(1).alias("_r"), F.col(what).alias("_w"))
    bucket = F.floor(F.col("_t") / BUCKET)
    both = both.unionByName(other, allowMissingColumns=True).withColumn("_bucket", bucket)
    w = Window.partitionBy(*by, "_bucket").orderBy(F.desc("_t"), F.desc("_r"), F.desc("_w")).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn(name, F.last("_w", True).over(w)).filter("_r = 0")
    # one row a bucket: its first right row, and that of the next bucket with one
    firsts = other.groupBy(*by, bucket.alias("_bucket")).agg(F.min(F.struct("_t", "_w")).alias("_first"))
    buckets = left.select(*by, F.floor(F.col(at) / BUCKET).alias("_bucket")).distinct().join(firsts, [*by, "_bucket"], "full")
    later = Window.partitionBy(*by).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(*by, "_bucket", F.last("_first._w", True).over(later).alias("_later"))
    out = near.join(buckets, [*by, "_bucket"], "left").withColumn(name, F.coalesce(name, "_later"))
    return out.drop("_t", "_r", "_w", "_bucket", "_later")


def targets_by_time(windows: DataFrame, horizon: int = 24, count: int = 3, anchor: str = "start_idx") -> DataFrame:
    """window_id and target_ids: ``count`` windows in a row from the first that starts at anchor + horizon or later."""
    keys = series_keys(windows)
    placed = numbered(windows, "start_idx", keys)
    ask = placed.select(*keys, "window_id", F.col("pos").alias("own"), (F.col(anchor) + horizon).alias("at"))
    first = forward_asof(ask, placed, "at", "start_idx", "pos", keys).withColumn("first", F.greatest("pos", F.col("own") + 1)).filter("pos is not null")
    asked = first.select(*keys, "window_id", F.explode(F.sequence("first", F.col("first") + count - 1)).alias("pos"))
    found = asked.join(placed.select(*keys, "pos", F.col("window_id").alias("target_id")), [*keys, "pos"])
    ids = found.groupBy(*keys, "window_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "target_id"))), lambda v: v["target_id"]).alias("target_ids"))
    return ids.filter(F.size("target_ids") == count)


def samples(windows: DataFrame, labels: DataFrame | None = None, horizon: int = 24, stride: int = 1, history: int = 4, count: int = 24, same_block: bool = False) -> DataFrame:
    """source_window_id (and the series), history_ids, target_ids, and with labels their pattern ids (-1 where a window has none).
    A window's id need be unique in its series alone; labels without series hold for all of them.

    Vectors stay in their own table and are joined by id when they are needed: a sample repeats none.
    """
    keys = series_keys(windows)
    own = [*keys, "window_id"]
    out = history_frames(windows, history).select(*own, "history_ids").join(targets_at_offsets(windows, horizon, stride, count), own)
    if same_block:
        blocks = windows.select(*keys, F.col("window_id").alias("id"), "block_id")
        each = out.select(*own, F.explode(F.concat("history_ids", "target_ids")).alias("id")).join(blocks, [*keys, "id"])
        whole = each.groupBy(*own).agg(F.min("block_id").alias("a"), F.max("block_id").alias("z"), F.count("block_id").alias("n"), F.count(F.lit(1)).alias("m")).filter("a = z and n = m")
        out = out.join(whole.select(*own), own, "left_semi")
    if labels is not None:
        for ids in ("history_ids", "target_ids"):
            side = series_keys(windows, labels)
            each = out.select(*own, F.posexplode(ids).alias("k", "id")).join(labels.select(*side, F.col("window_id").alias("id"), "pattern_id"), [*side, "id"], "left")
            each = each.groupBy(*own).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("pattern_id", F.lit(-1)).alias("p")))), lambda v: v["p"]).alias(ids.replace("_ids", "_patterns")))
            out = out.join(each, own)
    return out.withColumnRenamed("window_id", "source_window_id")


def chronological_split(df: DataFrame, order: str, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """df with pos and split, each series by itself. Cuts are at int(n * share), at least one row away from the ends; fewer than 4
    rows can't be split, and rows without an order have no place.
    """
    keys = series_keys(df)
    n = df.filter(F.col(order).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    out = numbered(df, order, keys)
    out = out.join(n, list(keys)) if keys else out.join(F.broadcast(n))  # one row without series
    a = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.floor(F.col("_n") * train)))
    z = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.floor(F.col("_n") * (train + validation))))
    z = F.when(z <= a, F.least(F.col("_n") - 1, a + 1)).otherwise(z)
    return out.withColumn("split", F.when(F.col("pos") < a, "train").when(F.col("pos") < z, "validation").otherwise("test")).drop("_n")


def stitched(parts: list[tuple[DataFrame, int, int | None]]) -> DataFrame:
    """Forecasts joined by horizon: of each (forecast, first, end) the rows with first <= horizon < end."""
    out = None
    for df, first, end in parts:
        cut = df.filter(F.col("horizon") >= first) if end is None else df.filter((F.col("horizon") >= first) & (F.col("horizon") < end))
        out = cut if out is None else out.unionByName(cut)
    return out


def boundary_union(*segments: DataFrame) -> DataFrame:
    """The distinct starts and ends of all segments (of each series), with how many segment tables have each: idx, n_tables."""
    keys = series_keys(*segments)
    out = None
    for i, s in enumerate(segments):
        b = s.select(*keys, F.explode(F.array("start_idx", "end_idx")).alias("idx")).distinct().withColumn("_k", F.lit(i))
        out = b if out is None else out.unionByName(b)
    return out.groupBy(*keys, "idx").agg(F.count(F.lit(1)).alias("n_tables"))


def next_targets(series: DataFrame, value: str = "x", hours: int = 24, keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    """keys, idx and the array of the next ``hours`` values less the value at idx, where all of them are known. One frame over one sort."""
    w = Window.partitionBy(*keys).orderBy("idx")
    ahead = w.rowsBetween(1, hours)
    got = series.withColumn("_n", F.count(value).over(ahead)).withColumn("_v", F.collect_list(value).over(ahead)).filter((F.col("_n") == hours) & F.col(value).isNotNull())
    return got.select(*keys, "idx", F.transform("_v", lambda v: v - F.col(value)).alias("target"))


def padded_targets(rows: DataFrame, v: str = "v", count: int = 48, order: str = "segment_id", keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    """keys, the order, targets and n_valid: the vectors of the next ``count`` rows, filled up with vectors of zeros; the first
    n_valid are real. One frame over one sort.
    """
    ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(1, count)
    got = rows.select(*keys, order, v).withColumn("_next", F.collect_list(v).over(ahead))
    zeros = F.transform(F.col(v), lambda x: F.lit(0.0).cast("double"))
    fill = F.array_repeat(zeros, count - F.size("_next"))
    return got.select(*keys, order, F.concat("_next", fill).alias("targets"), F.size("_next").cast("long").alias("n_valid"))


def place_range(df: DataFrame, skip: int = 0, limit: int | None = None, order: str = "start_idx", keys: tuple[str, ...] = ()) -> DataFrame:
    """df with pos: the rows from place ``skip`` on in the order, at most ``limit`` of them."""
    out = numbered(df, order, keys).filter(F.col("pos") >= skip)
    return out if limit is None else out.filter(F.col("pos") < skip + limit)


def last_rows(df: DataFrame, count: int, order: str, keys: tuple[str, ...] = ("channel",), before: object = None) -> DataFrame:
    """The last ``count`` rows of each series in the order, of those before a bound if there is one; place 0 is the earliest of them."""
    if before is not None:
        df = df.filter(F.col(order) < before)
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    back = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= count)
    return back.withColumn("place", F.max("_r").over(Window.partitionBy(*keys)) - F.col("_r")).drop("_r")


def running_k(durations: Column, total: float, most: int, order: str, keys: tuple[str, ...] = ()) -> Column:
    """How many items, taken in order, it takes for their durations to reach ``total``; at most ``most``. A frame column."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum(durations).over(w) - durations
    return F.when((before < total) & (F.count(F.lit(1)).over(w) <= most), 1).otherwise(0)


def yearly_anchors(daily: DataFrame, day_of_year: int, within: int = 7, day: str = "day") -> DataFrame:
    """Of each year the day nearest to a day of the year, at most ``within`` away (the first on a tie): year, off and the day's columns."""
    near = daily.withColumns({"year": F.year(day).cast("long"), "off": F.abs(F.dayofyear(day) - day_of_year).cast("long")}).filter(F.col("off") <= within)
    first = F.row_number().over(Window.partitionBy("year").orderBy("off", day))
    return near.withColumn("_r", first).filter("_r = 1").drop("_r")
