"""The registered queries of the time-series operators over the given tables, by name.

Floats are rounded, so that engines that add in another order give the same rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import sql
from tidemark.operators import clustering, decode, events, forecasters, histories, metrics, pairs, predictors, samples, segments, signal, structure, windows
from tidemark.plans import pipeline
from tidemark.sources import observations, sinks
from tidemark.streaming import grid as streams
from tidemark.streaming import segments as stream_segments

COMPOUND = ("purchase", "view")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a number of places, halves away from zero: as decimals of twelve places, which float error doesn't reach, so that
    a half is a half in every engine.
    """
    return df.select(*[F.round(F.col(c).cast("decimal(38,12)"), places).cast("double").alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def grid(spark: SparkSession, d: str) -> DataFrame:
    return signal.hourly_grid(table(spark, d, "events"), places=8)


def sig(spark: SparkSession, d: str) -> DataFrame:
    return signal.signal(grid(spark, d), places=10)


def channels(df: DataFrame) -> list[str]:
    """The names of all channels, in order."""
    return sorted(r["channel"] for r in df.select("channel").distinct().collect())


def n_steps(df: DataFrame) -> int:
    """Steps of the dense calendar: one number."""
    return int((df.agg(F.max("idx")).first()[0] or -1) + 1)


def window_table(spark: SparkSession, d: str) -> DataFrame:
    """window_id, start_idx, end_idx, block_id (five days) of the sliding windows, which all channels share."""
    steps = grid(spark, d).select("idx").distinct().withColumn("series", F.lit(0))
    w = windows.starts(steps, 24, 1, ("series",))
    return w.select("window_id", F.col("idx").alias("start_idx"), (F.col("idx") + 23).alias("end_idx"), F.floor(F.col("idx") / 120).alias("block_id"))


def hourly_channel_grid(spark, d):
    return rounded(grid(spark, d).select("channel", "idx", "ts", "x"))


def quality_mask(spark, d):
    flag = F.when(F.col("l_linenumber") < 7, F.col("l_linenumber"))
    rows = table(spark, d, "lineitem").withColumn("flag", flag)
    rows = signal.quality_masked(rows, [("l_extendedprice", "flag")])
    return rounded(rows.groupBy("l_returnflag").agg(F.count("l_extendedprice").alias("n_valid"), F.count(F.lit(1)).alias("n"), F.avg("l_extendedprice").alias("mean_valid")), 4)


def date_slice(spark, d):
    rows = signal.date_slice(table(spark, d, "orders"), "1995-01-01", "1996-12-31", ts="o_orderdate")
    return rounded(rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean_price")), 4)


def long_form(spark, d):
    g = grid(spark, d)
    names = channels(g)
    return rounded(signal.to_long(signal.to_wide(g, names), names, keep=("idx",)).filter("x is not null").select("channel", "idx", "x"))


def rolling_mean(spark, d):
    return rounded(sig(spark, d).select("channel", "idx", "s"))


def differences(spark, d):
    return rounded(sig(spark, d).select("channel", "idx", "d1", "d2"))


def savgol(spark, d):
    return rounded(signal.savgol(grid(spark, d), places=10).select("channel", "idx", "s"))


def linear_interp(spark, d):
    return rounded(grid(spark, d).withColumn("filled", signal.linear_filled(F.col("x"))).select("channel", "idx", "filled"))


def extrema_events(spark, d):
    return rounded(events.extrema(sig(spark, d)).drop("ts"))


def peak_events(spark, d):
    return rounded(events.peaks(sig(spark, d)).drop("ts"))


def channel_thresholds(spark, d):
    return rounded(windows.thresholds(grid(spark, d)))


def window_intra(spark, d):
    return rounded(windows.intra_features(sig(spark, d)))


def window_hazard(spark, d):
    g = grid(spark, d)
    return rounded(windows.hazard_features(signal.signal(g, places=10), windows.thresholds(g), COMPOUND))


def event_window_bridge(spark, d):
    s = sig(spark, d)
    bridge = windows.event_bridge(events.extrema(s), n_steps(s))
    return bridge.groupBy("window_id", "channel", "sign").agg(F.count(F.lit(1)).alias("n_events"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


def window_time_block(spark, d):
    s = sig(spark, d)
    n = n_steps(s)
    out = windows.time_block(windows.event_bridge(events.extrema(s), n), windows.event_bridge(events.peaks(s), n))
    return rounded(out.withColumn("mean_place", F.coalesce(F.try_divide(F.aggregate("places", F.lit(0.0), lambda a, b: a + b), F.size("places").cast("double")), F.lit(0.0))).drop("places"))


def window_pairs(spark, d):
    s = sig(spark, d)
    return rounded(pairs.correlations(pairs.pairs_of(s, channels(s))), 5)


def sync_extrema(spark, d):
    s = sig(spark, d)
    return rounded(pairs.synchronous(s, n_steps(s)))


def one_step_predictors(spark, d):
    return rounded(predictors.one_step(sig(spark, d)).select("channel", "idx", "level", "velocity", "acceleration"))


def predictor_scoreboard(spark, d):
    return rounded(predictors.scoreboard(sig(spark, d)))


def predictor_board(spark, d):
    """All four predictors over each channel's known values."""
    return rounded(predictors.board(sig(spark, d)))


def circular_error(spark, d):
    g = grid(spark, d).withColumn("deg", predictors.wrapped(F.col("x") * 7)).withColumn("was", F.lag("deg").over(signal.ordered()))
    return rounded(g.filter("deg is not null and was is not null").groupBy("channel").agg(F.avg(predictors.circular_error(F.col("deg"), F.col("was"))).alias("mean_error")))


def ids(df: DataFrame) -> DataFrame:
    """Id arrays as text."""
    return df.select(*[F.concat_ws(",", c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


def history_frames(spark, d):
    return ids(samples.history_frames(window_table(spark, d)).select("window_id", "history_ids"))


def target_lookup(spark, d):
    return ids(samples.targets_at_offsets(window_table(spark, d)))


def forward_asof_target(spark, d):
    return ids(samples.targets_by_time(window_table(spark, d), 24, 3, "end_idx"))


def sequence_samples(spark, d):
    w = window_table(spark, d)
    return ids(samples.samples(w, w.select("window_id", F.col("block_id").alias("pattern_id")), count=6, same_block=True))


def chronological_split(spark, d):
    return samples.chronological_split(window_table(spark, d).select("window_id", "start_idx"), "start_idx").select("window_id", "pos", "split")


def _backtest(spark, d, drift: bool):
    """Errors of the last value carried on, or drawn towards the upper threshold."""
    g = grid(spark, d)
    p = metrics.persistence(g)
    if drift:
        p = p.join(windows.thresholds(g), "channel").withColumn("prediction", F.col("prediction") + (F.col("upper") - F.col("prediction")) * F.col("horizon") / 240)
    return metrics.errors(metrics.with_actual(p.select("channel", "idx", "horizon", "prediction"), g))


def persistence_backtest(spark, d):
    return rounded(_backtest(spark, d, False).withColumn("horizon", F.coalesce("horizon", F.lit(0))))  # 0: all


def drift_backtest(spark, d):
    return rounded(_backtest(spark, d, True).withColumn("horizon", F.coalesce("horizon", F.lit(0))))


def hourly_scoreboard(spark, d):
    return rounded(metrics.hourly_scoreboard(_backtest(spark, d, True)).withColumn("horizon", F.coalesce("horizon", F.lit(0))))


def evaluation_payload(spark, d):
    return rounded(metrics.payload(_backtest(spark, d, True)).withColumn("horizon", F.coalesce("horizon", F.lit(0))))


def longest_peaks(spark, d):
    """The 20 widest peaks."""
    return rounded(metrics.longest(events.peaks(sig(spark, d)).select("channel", "idx", "sign", "width"), "width", ["channel", "idx"]))


def segment_histories(spark, d):
    """Of hourly centres, the segments five days before and after: at most the last and first four."""
    s = _line_segments(spark, d)
    keys = ("channel",)
    at = histories.centres(s, 120, 1, keys)
    out = histories.around(s, at, 120, 4, keys)
    first = histories.members(out, s.select("channel", "start_idx", "segment_id"), "tail", 4, keys).groupBy("channel", "centre").agg(F.min("segment_id").alias("first_segment"), F.max("slot").alias("last_slot"))
    out = out.select("channel", "centre", (F.col("tail_to") - F.col("tail_from")).alias("n_tail"), (F.col("head_to") - F.col("head_from")).alias("n_head"))
    return out.join(first, ["channel", "centre"], "left")


def placeholder_decode(spark, d):
    """The time block of each window, halved and read back as a forecast's would be."""
    b = window_time_block(spark, d)
    v = F.array(F.lit(1.0), F.col("mean_gap") * 3, F.col("var_gap"), "mean_gap", "var_gap", "mean_width", "max_width", F.col("n_events") / 2, "mean_place")
    t = b.select("window_id", decode.time_placeholders(v, ["all"]).alias("t"))
    return rounded(t.select("window_id", "t.window_length_steps", "t.forecast_horizon_steps", "t.mean_peak_width_steps", F.size("t.normalized_event_positions").cast("long").alias("n_positions"), F.col("t.duration_over_threshold_by_channel")["all"].alias("over")), 5)


def boundary_union(spark, d):
    e = events.extrema(sig(spark, d)).select("channel", "idx")
    tables = [e.filter(F.col("channel") == c).select(F.col("idx").alias("start_idx"), (F.col("idx") + 1).alias("end_idx")) for c in channels(e)]
    return samples.boundary_union(*tables)


def index_intersection(spark, d):
    """Steps that all channels have values at."""
    g = grid(spark, d)
    known = g.filter("x is not null")
    return functools.reduce(DataFrame.intersect, [known.filter(F.col("channel") == c).select("idx") for c in channels(g)])


def ensemble_stitch(spark, d):
    g = grid(spark, d)
    p = metrics.persistence(g, 36)
    th = windows.thresholds(g)
    up, low = (p.join(th, "channel").select("channel", "idx", "horizon", F.col(c).alias("prediction")) for c in ("upper", "lower"))
    out = samples.stitched([(p.select("channel", "idx", "horizon", "prediction"), 0, 12), (low, 12, 24), (up, 24, None)])
    return rounded(out.groupBy("channel", "horizon").agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("mean_prediction")))


def linear_fit_by_block(spark, d):
    return rounded(segments.linear_fits(grid(spark, d), 24))


def _line_segments(spark, d):
    f = segments.linear_fits(grid(spark, d), 24)
    eq = F.when(F.col("block") % 3 == 0, "constant").when(F.col("block") % 3 == 1, "linear").otherwise("harmonic")
    return f.select("channel", F.col("block").alias("segment_id"), (F.col("block") * 24).alias("start_idx"), (F.col("block") * 24 + 23).alias("end_idx"), F.lit(24).cast("long").alias("duration"), eq.alias("eq_type"), F.col("intercept").alias("L"), F.col("slope").alias("c"), F.lit(0.0).alias("lam"), (F.col("mean") - F.col("intercept")).alias("A"), F.col("slope").alias("B"), F.abs("slope").alias("rms"))


def equation_eval(spark, d):
    return rounded(segments.evaluated(_line_segments(spark, d), grid(spark, d)))


def segment_report(spark, d):
    return rounded(metrics.segment_report(_line_segments(spark, d)), 4)


def segment_vectors(spark, d):
    kinds, scales = ["harmonic", "linear", "constant"], {"L": 50.0, "c": 2.0, "A": 10.0}
    s = _line_segments(spark, d).withColumn("v", decode.segment_vector(kinds, scales))
    s = s.withColumn("back", decode.segment_of(F.col("v"), kinds, scales))
    return rounded(s.select("channel", "segment_id", "back.eq_type", "back.L", "back.c", "back.A", "back.B", "back.duration", F.aggregate("v", F.lit(0.0), lambda a, b: a + b).alias("total")))


def decoded_series(spark, d):
    return rounded(segments.decoded(_line_segments(spark, d), 10.0, 200))


def extrapolated_errors(spark, d):
    g = grid(spark, d)
    s = _line_segments(spark, d).filter(F.col("end_idx") < n_steps(g) - 48)  # the last two days are held out
    p = segments.extrapolated(s, 48).join(g.filter("x is not null").select("channel", "idx", "x"), ["channel", "idx"])
    return rounded(p.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("x") - F.col("prediction"))).alias("mae")))


def p90_scales(spark, d):
    return rounded(metrics.column_scales(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), 4)


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def robust_scale(spark, d):
    return rounded(metrics.robust_scales(vectors(spark, d), "v"))


def vector_norm_stats(spark, d):
    return rounded(metrics.vector_scales(vectors(spark, d), "v"))


def time_features(spark, d):
    days = table(spark, d, "orders").select(F.col("o_orderdate").alias("day")).distinct()
    return rounded(days.select("day", *decode.time_features(F.col("day"))))


def running_duration_k(spark, d):
    p = events.peaks(sig(spark, d)).select("channel", "idx", "width")
    p = p.withColumn("used", samples.running_k(F.col("width"), 48.0, 48, "idx", ("channel",)))
    return p.groupBy("channel").agg(F.sum("used").cast("long").alias("k"))


def next24_targets(spark, d):
    t = samples.next_targets(grid(spark, d))
    return rounded(t.select("channel", "idx", F.posexplode("target").alias("step", "delta")).withColumn("step", F.col("step").cast("long")))


def window_decode(spark, d):
    f = windows.intra_features(sig(spark, d)).withColumn("sample_id", F.floor(F.col("window_id") / 24)).withColumn("step", F.col("window_id"))
    return rounded(f.withColumn("value", decode.decoded_value()).select("sample_id", "channel", "step", "value"))


def interval_values(spark, d):
    g = grid(spark, d)
    known = g.filter("x is not null").select("channel", F.col("idx").cast("double").alias("t"), F.col("x").alias("v"))
    return rounded(decode.interpolated(known, g.select("channel", (F.col("idx") * 1.5).alias("t")), keys=("channel",)))


def anchor_days(spark, d):
    daily = table(spark, d, "orders").groupBy(F.col("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("total"))
    return rounded(samples.yearly_anchors(daily, 60).select("year", "day", "off", "total"), 2)


def scaled_features(spark, d):
    return rounded(structure.scaled_features(window_intra(spark, d), window_hazard(spark, d)), 5)


def scaled_pairs(spark, d):
    return rounded(structure.scaled_pairs(window_pairs(spark, d), sync_extrema(spark, d)), 4)


def label_lookup(spark, d):
    s = sig(spark, d)
    w = window_table(spark, d).select("window_id", "block_id")
    maxima = events.extrema(s).filter("sign = 'max' and amplitude > 20")
    labels = windows.event_bridge(maxima, n_steps(s)).groupBy("window_id").agg(F.count(F.lit(1)).alias("pattern_id"))
    return w.join(labels, "window_id", "left").groupBy("block_id", F.coalesce("pattern_id", F.lit(-1)).alias("pattern_id")).agg(F.count(F.lit(1)).alias("n"))


def _prototypes(spark, d):
    v = vectors(spark, d)
    return clustering.centroids(v, v.select("id", F.col("label").alias("pattern_id")))


def nearest_prototype(spark, d):
    return rounded(clustering.nearest(vectors(spark, d), _prototypes(spark, d)), 5)


def lloyd_step(spark, d):
    return rounded(clustering.lloyd_step(vectors(spark, d), _prototypes(spark, d)))


def cluster_quality(spark, d):
    return rounded(clustering.quality(clustering.nearest(vectors(spark, d), _prototypes(spark, d))))


# Through files of other formats, written from the tables in the shared folder and read back.


def observations_csv(spark, d):
    """Each event a line of an observation file, below a preamble: values and flags, some missing or unreadable, times of minutes."""
    cells = ["lower(date_format(ts, 'dd-MMM-yyyy HH:mm'))", "user_id % 4", "value", "case when user_id % 5 < 4 then string(user_id % 5) else ' ' end", "case when event_id % 9 = 0 then 'x' else string(value * 2) end"]
    e = table(spark, d, "events").select("event_id", F.concat_ws(",", *[F.coalesce(F.expr(c).cast("string"), F.lit("")) for c in cells]).alias("line"))
    path = sinks.fresh_path(spark)
    sinks.write_lines(e, path, "event_id", ("Station: events", "values, flags", "Date,ind,rain,ind,temp"))
    return rounded(observations.read_observations(spark, path).select("ts", "rainfall", "temperature", "pressure", *[F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("rain_quality", "temp_quality")]))  # -1: missing


def history_json_lines(spark, d):
    """Histories of windows as compressed JSON lines and back."""
    path = sinks.fresh_path(spark)
    sinks.write_json_lines(samples.history_frames(window_table(spark, d)).select("window_id", "history_ids"), path)
    back = observations.read_json_lines(spark, path, "window_id long, history_ids array<long>")
    return back.select("window_id", F.posexplode("history_ids").alias("place", "member_id")).withColumn("place", F.col("place").cast("long"))


def history_flat_csv(spark, d):
    """Histories of windows as CSV with arrays as text, and back."""
    path = sinks.fresh_path(spark)
    sinks.write_csv(samples.history_frames(window_table(spark, d)).select("window_id", "start_idx", "history_ids"), path)
    return spark.read.option("header", True).schema("window_id long, start_idx long, history_ids string").csv(path)


def stored_extrema(spark, d):
    """Extrema as a table partitioned by channel, of which one sign and three columns are read."""
    path = sinks.fresh_path(spark)
    sinks.write_table(events.extrema(sig(spark, d)).drop("ts"), path, ("channel",))
    return rounded(observations.read_table(spark, path, ("channel", "idx", "sign", "amplitude")).filter("sign = 'max'"))


def _streamed_hours(spark, d) -> str:
    """Path of the hourly means of the events as a stream: of the hours that the watermark has closed."""
    source, out = f"{d}/events[.]parquet", sinks.fresh_path(spark)  # a pattern, as a stream takes no single file
    hours = streams.hourly(spark.readStream.schema(table(spark, d, "events").schema).parquet(source))
    query = hours.writeStream.format("parquet").option("path", out).option("checkpointLocation", sinks.fresh_path(spark)).trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def streamed_hours(spark, d):
    return rounded(spark.read.parquet(_streamed_hours(spark, d)).select("channel", F.col("ts").cast("timestamp_ntz").alias("ts"), "x"))


def streamed_extrema(spark, d):
    """Turns of the hourly stream's differences, by the streaming state of each channel."""
    hours, out = _streamed_hours(spark, d), sinks.fresh_path(spark)
    stream = spark.readStream.schema("channel string, ts timestamp, x double").parquet(hours).select("channel", "ts", F.round("x", 8).alias("x"))
    query = streams.extrema(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", sinks.fresh_path(spark)).trigger(availableNow=True).start()
    query.awaitTermination()
    return rounded(spark.read.parquet(out).select("channel", F.col("ts").cast("timestamp_ntz").alias("ts"), "sign", "amplitude", "first_diff"), 5)


def streamed_once(spark, d):
    """The hourly stream where every event comes twice: the same hours as from each once."""
    source, out = f"{d}/events[.]parquet", sinks.fresh_path(spark)
    events_ = spark.readStream.schema(table(spark, d, "events").schema).parquet(source)
    query = streams.hourly(events_.unionByName(events_), ids=("event_id",)).writeStream.format("parquet").option("path", out).option("checkpointLocation", sinks.fresh_path(spark)).trigger(availableNow=True).start()
    query.awaitTermination()
    return rounded(spark.read.parquet(out).select("channel", F.col("ts").cast("timestamp_ntz").alias("ts"), "x"))


def streamed_segments(spark, d):
    """Segments that the hourly stream closes, by the typed state of each channel."""
    hours, out = _streamed_hours(spark, d), sinks.fresh_path(spark)
    stream = spark.readStream.schema("channel string, ts timestamp, x double").parquet(hours)
    with stream_segments.state_store(spark):
        query = stream_segments.closed_segments(stream, 12.0, order="ts").writeStream.format("parquet").option("path", out).option("checkpointLocation", sinks.fresh_path(spark)).trigger(availableNow=True).start()
        query.awaitTermination()
    back = spark.read.parquet(out)
    return rounded(back.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_idx", "end_idx")}))


def reindexed_steps(spark, d):
    """The second ten days numbered anew: at most 200 steps a channel."""
    g = grid(spark, d).filter("x is not null and idx >= 240").select("channel", "ts", "x")
    return rounded(signal.reindexed(g, max_rows=200))


def window_range(spark, d):
    """Windows of places 100 to 299."""
    return samples.place_range(window_table(spark, d), 100, 200).select("pos", "window_id", "start_idx", "block_id")


def seed_history(spark, d):
    """The last 14 days of each order priority before 1997."""
    days = table(spark, d, "orders").groupBy("o_orderpriority", F.col("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("mean_price"))
    out = samples.last_rows(days, 14, "day", ("o_orderpriority",), F.lit("1997-01-01").cast("timestamp_ntz"))
    return rounded(out.withColumn("place", F.col("place").cast("long")), 4)


def padded_segment_targets(spark, d):
    """Of each segment the vectors of the next 48, filled up with zeros, summed up by place."""
    s = _line_segments(spark, d).withColumn("v", F.array("L", "c", "A", F.col("duration") / 24))
    t = samples.padded_targets(s).select("channel", "segment_id", "n_valid", F.posexplode("targets").alias("step", "v"))
    return rounded(t.select("channel", "segment_id", "n_valid", F.col("step").cast("long").alias("step"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total")))


def equation_counts(spark, d):
    """Segments, their mean duration and share by equation and channel."""
    return rounded(metrics.shares(_line_segments(spark, d), ("channel",), "eq_type"))


def boundary_synchrony(spark, d):
    """How many extrema steps are shared by how many channels."""
    at = events.extrema(sig(spark, d)).groupBy("idx").agg(F.count_distinct("channel").alias("n_channels"))
    return at.groupBy("n_channels").agg(F.count(F.lit(1)).alias("n"))


def decoded_hazards(spark, d):
    """Hazard blocks of all windows read back as series on a grid of one and a half steps."""
    h = window_hazard(spark, d)
    names, chans = windows.HAZARD, channels(h)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), "channel", F.col(n).cast("double").alias("x")) for i, n in enumerate(names)]))
    blocks = h.select("window_id", each.alias("p")).groupBy(F.col("window_id").alias("t")).agg(F.array_sort(F.collect_list("p")).alias("p")).select("t", F.col("p")["x"].alias("hazard"))
    return rounded(decode.decoded_hazards(blocks, blocks.select((F.col("t") * 1.5).alias("t")), chans, names), 5)


# Without SQL: these depend on the order of steps or iterate.


def regime_labels(spark, d):
    return predictors.labelled(sig(spark, d))


def switch_counts(spark, d):
    return predictors.switch_counts(regime_labels(spark, d))


def regime_blocks(spark, d):
    return predictors.regimes(regime_labels(spark, d))


def hierarchical_windows(spark, d):
    return predictors.windows_in_blocks(regime_blocks(spark, d), 24)


def walk_forward_segments(spark, d):
    return rounded(segments.segmented(sig(spark, d).filter("s is not null"), tolerance=12.0, value="s"))


def sql_segments(spark, d):
    """The walk as a table function in SQL, its equations evaluated at the segments' ends."""
    sql.register(spark)
    sig(spark, d).filter("s is not null").select("channel", "idx", F.col("s").alias("x")).createOrReplaceTempView("smoothed_series")
    out = spark.sql("SELECT *, segment_value(eq_type, L, c, lam, A, B, CAST(duration - 1 AS DOUBLE)) AS last_value FROM walk_segments(TABLE(smoothed_series) PARTITION BY channel ORDER BY (idx), 12.0D, true)")
    return rounded(out)


def walk_forward_report(spark, d):
    return rounded(metrics.segment_report(walk_forward_segments(spark, d)), 4)


def joint_segments(spark, d):
    s = sig(spark, d).filter("s is not null")
    cuts = segments.segmented(s, tolerance=12.0, harmonic=False, value="s")
    return rounded(segments.joint_refit(samples.boundary_union(cuts), s, value="s", harmonic=channels(s)[:1]))


def dynamics_pieces(spark, d):
    s = sig(spark, d)
    return rounded(segments.dynamics_fits(s, segments.dynamics_boundaries(s)))


def top_signatures(spark, d):
    """The twelve combinations of predictors that cover most steps."""
    labels = regime_labels(spark, d)
    return predictors.top_signatures(labels, predictors.regimes(labels))


def label_shares(spark, d):
    return rounded(predictors.label_shares(regime_labels(spark, d)))


def dynamics_medoids(spark, d):
    """Medoids of all pieces by the integrals between their dynamics, k by silhouette and balance; every piece to its nearest medoid."""
    path = sinks.fresh_path(spark)  # the rounds read the pieces' vectors, which are fitted once
    sinks.write_table(structure.functional_vectors(dynamics_pieces(spark, d)).withColumnRenamed("segment_id", "id"), path)
    v = observations.read_table(spark, path)
    table_, _ = clustering.select_medoids(v)
    return rounded(clustering.nearest(v, table_))


def ridge_backtest(spark, d):
    """Ridge regressions on windows' features, fitted on the first 70 % of the windows, against the last value on the later ones."""
    s = sig(spark, d)
    return rounded(pipeline.backtest(pipeline.feature_vectors(windows.intra_features(s), channels(s)), s, horizons=6).withColumn("horizon", F.coalesce("horizon", F.lit(0))))


def sequence_forecasts(spark, d):
    """Errors by step of a recurrent network on the test part of the sequence samples, and of the last window carried on."""
    s = sig(spark, d)
    names, path = channels(s), sinks.fresh_path(spark)
    sinks.write_table(pipeline.feature_vectors(windows.intra_features(s), names), f"{path}/vectors")
    vectors_ = observations.read_table(spark, f"{path}/vectors")
    shape = forecasters.Shape(4, 6, 13 * len(names))
    parts = forecasters.split_blocks(samples.samples(window_table(spark, d), count=shape.target), vectors_, shape, path)
    model, last = forecasters.Recurrent(shape).fit(parts["train"]), forecasters.LastWindow(shape)
    return rounded(forecasters.forecast_errors(model.predict(parts["test"]), last.predict(parts["test"])))


def kmeans_clusters(spark, d):
    k, _, labels, _ = clustering.select_k(vectors(spark, d), range(8, 33, 4), rounds=50)
    return rounded(labels.withColumn("k", F.lit(k)))


def leader_patterns(spark, d):
    v = vectors(spark, d)
    labels, table_, _ = clustering.leader_clusters(v)
    mean = table_.withColumnRenamed("v", "mean")
    own = v.join(labels, "id").join(F.broadcast(mean), "pattern_id")  # at most 96 rows
    return rounded(own.select("id", "pattern_id", F.sqrt(clustering.squared_distance(F.col("v"), F.col("mean"))).alias("distance")))


ALL = [
    hourly_channel_grid, quality_mask, date_slice, long_form, rolling_mean, differences, savgol, linear_interp, extrema_events, peak_events, channel_thresholds, window_intra, window_hazard,
    event_window_bridge, window_time_block, window_pairs, sync_extrema, one_step_predictors, predictor_scoreboard, predictor_board, circular_error, history_frames, target_lookup, forward_asof_target, sequence_samples,
    chronological_split, persistence_backtest, drift_backtest, hourly_scoreboard, evaluation_payload, longest_peaks, segment_histories, placeholder_decode, boundary_union, index_intersection, ensemble_stitch, linear_fit_by_block, equation_eval, segment_report, segment_vectors, decoded_series,
    extrapolated_errors, p90_scales, robust_scale, vector_norm_stats, time_features, running_duration_k, next24_targets, window_decode, interval_values, anchor_days, scaled_features, scaled_pairs, label_lookup, nearest_prototype,
    lloyd_step, cluster_quality, regime_labels, switch_counts, regime_blocks, hierarchical_windows, walk_forward_segments, walk_forward_report, joint_segments, dynamics_pieces, dynamics_medoids, kmeans_clusters, leader_patterns, top_signatures, label_shares, ridge_backtest,
    observations_csv, history_json_lines, history_flat_csv, stored_extrema, streamed_hours, streamed_extrema, reindexed_steps, window_range, seed_history, padded_segment_targets, equation_counts,
    boundary_synchrony, decoded_hazards, streamed_once, streamed_segments, sql_segments, sequence_forecasts,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}
