"""Forecast errors by channel and horizon, against the last known value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.signal import series_keys


def persistence(series: DataFrame, horizons: int = 24, value: str = "x") -> DataFrame:
    """The last-value forecast: channel (and the series), idx (of the forecast), horizon, prediction."""
    known = series.filter(F.col(value).isNotNull()).select(*series_keys(series), "channel", "idx", F.col(value).alias("prediction"))
    return known.withColumn("horizon", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(horizons).cast("long"))))


def with_actual(forecast: DataFrame, series: DataFrame, value: str = "x") -> DataFrame:
    """forecast with actual, of the steps where it is known, and baseline, the value when the forecast was made; an equi-join on the target step."""
    keys = [*series_keys(forecast, series), "channel"]
    actual = series.filter(F.col(value).isNotNull()).select(*keys, F.col("idx").alias("at"), F.col(value).alias("actual"))
    base = series.filter(F.col(value).isNotNull()).select(*keys, "idx", F.col(value).alias("baseline"))
    finite = F.col("prediction").isNotNull() & ~F.isnan("prediction")
    return forecast.filter(finite).withColumn("at", F.col("idx") + F.col("horizon")).join(actual, [*keys, "at"]).join(base, [*keys, "idx"], "left")


def errors(joined: DataFrame) -> DataFrame:
    """count, mae and rmse per channel and per channel and horizon (null: all), of the model and of the baseline, in one pass."""
    e, b = F.col("prediction") - F.col("actual"), F.col("baseline") - F.col("actual")
    out = joined.withColumns({"_e": e, "_b": b}).groupingSets([["channel"], ["channel", "horizon"]], "channel", "horizon")
    return out.agg(
        F.count("_e").alias("n"),
        F.avg(F.abs("_e")).alias("mae"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
        F.count("_b").alias("baseline_n"),
        F.avg(F.abs("_b")).alias("baseline_mae"),
        F.sqrt(F.avg(F.col("_b") * F.col("_b"))).alias("baseline_rmse"),
    )


def hourly_scoreboard(by_channel: DataFrame) -> DataFrame:
    """Unweighted means over channels for each horizon; the row with a null horizon is over all."""
    return by_channel.filter("n > 0").groupBy("horizon").agg(F.count(F.lit(1)).alias("n_channels"), F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"))


def segment_report(segments: DataFrame) -> DataFrame:
    """Count, share, durations and mean rms by equation, and in total (eq_type null): a rollup."""
    out = segments.rollup("eq_type").agg(F.count(F.lit(1)).alias("n"), F.avg("duration").alias("mean_duration"), F.min("duration").alias("min_duration"), F.max("duration").alias("max_duration"), F.avg("rms").alias("mean_rms"), F.grouping("eq_type").alias("_all"))
    whole = F.max(F.when(F.col("_all") == 1, F.col("n"))).over(Window.partitionBy())
    return out.withColumn("pct", 100.0 * F.col("n") / whole).drop("_all")


def column_scales(df: DataFrame, columns: list[str], floor: float = 1e-6) -> DataFrame:
    """The 90th percentile of the absolute values above ``floor`` of each column; 1 where there are none."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("key"), F.abs(F.col(c).cast("double")).alias("x")) for i, c in enumerate(columns)])).alias("e")).select("e.*")
    found = exact_quantiles(each.filter(F.col("x") > floor), [0.9])
    return found.agg(*[F.coalesce(F.max(F.when(F.col("key") == i, F.col("q")[0])), F.lit(1.0)).alias(c) for i, c in enumerate(columns)])


def vector_scales(df: DataFrame, vector: str) -> DataFrame:
    """Mean and population deviation (1 if it is tiny) of each place of a vector column: pos, mean, std."""
    out = df.select(F.posexplode(vector).alias("pos", "v")).groupBy("pos").agg(F.avg(F.col("v").cast("double")).alias("mean"), F.stddev_pop(F.col("v").cast("double")).alias("std"))
    return out.withColumn("std", F.when(F.col("std") <= 1e-6, 1.0).otherwise(F.col("std")))


def robust_scales(df: DataFrame, vector: str) -> DataFrame:
    """Median and interquartile range (1 if it is tiny) of each place of a vector column: pos, center, scale."""
    out = exact_quantiles(df.select(F.posexplode(vector).alias("pos", "v")), [0.25, 0.5, 0.75], "pos", "v")
    span = F.col("q")[2] - F.col("q")[0]
    return out.select("pos", F.col("q")[1].alias("center"), F.when(span > 1e-6, span).otherwise(1.0).alias("scale"))


def payload(by_channel: DataFrame, first: int = 5) -> DataFrame:
    """The short report of an evaluation, one row a horizon: means over channels for all horizons (null) and for the first ones."""
    return hourly_scoreboard(by_channel).filter(F.col("horizon").isNull() | (F.col("horizon") <= first))


def longest(df: DataFrame, by: str, ties: list[str], k: int = 20) -> DataFrame:
    """The k rows with the greatest ``by``; ties by the named columns."""
    return df.orderBy(F.desc(by), *ties).limit(k)


def shares(df: DataFrame, keys: tuple[str, ...], kind: str) -> DataFrame:
    """keys, kind, n and the kind's share of the key's rows."""
    n = df.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
