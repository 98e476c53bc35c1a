"""Extrema of the first difference and peaks of the smoothed level, by window functions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.signal import KEYS, backwards, ordered


def turning(x, keys: Sequence[str]):
    """'max' where x rises to a value and doesn't rise after it, 'min' where it falls and doesn't fall; else null."""
    w = ordered(keys)
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    return F.when((before < x) & (x >= after), "max").when((before > x) & (x <= after), "min")


def with_extrema(sig: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """sig with ext_sign and ext_amplitude, null but at extrema."""
    w = ordered(keys)
    sign = turning(F.col("d1"), keys)
    amplitude = F.abs(F.col("d1") - (F.lag("d1").over(w) + F.lead("d1").over(w)) / 2)
    return sig.withColumn("ext_sign", sign).withColumn("ext_amplitude", F.when(F.col("ext_sign").isNotNull(), amplitude))


def extrema(sig: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Extremum events: keys, idx, ts, sign, amplitude, value, first_diff, second_diff."""
    out = with_extrema(sig, keys).filter("ext_sign is not null")
    return out.select(*keys, "idx", "ts", F.col("ext_sign").alias("sign"), F.col("ext_amplitude").alias("amplitude"), F.col("s").alias("value"), F.col("d1").alias("first_diff"), F.col("d2").alias("second_diff"))


def with_peaks(sig: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """sig with peak_sign, left_idx, right_idx, left_base, right_base, null but at peaks.

    A peak's feet are where walking outwards would stop: at the first step against the slope, at a null, or at the
    end. A running maximum of the places where a walk to the left stops, and from the series' end a running minimum of those
    to the right, gives both without a loop.
    """
    w, s = ordered(keys), F.col("s")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), backwards(keys)
    before, after = F.lag("s").over(w), F.lead("s").over(w)
    out = sig.withColumn("peak_sign", turning(s, keys))
    # a walk up to here from the left goes on while before <= s (for a maximum); it stops on this row otherwise
    stops = {
        "_up_l": F.when(~F.coalesce(before <= s, F.lit(False)), F.col("idx")),
        "_dn_l": F.when(~F.coalesce(before >= s, F.lit(False)), F.col("idx")),
        "_up_r": F.when(~F.coalesce(after <= s, F.lit(False)), F.col("idx")),
        "_dn_r": F.when(~F.coalesce(after >= s, F.lit(False)), F.col("idx")),
    }
    out = out.withColumns(stops)
    top = F.col("peak_sign") == "max"
    out = out.withColumn("left_idx", F.when(top, F.max("_up_l").over(back)).when(F.col("peak_sign").isNotNull(), F.max("_dn_l").over(back)))
    out = out.withColumn("right_idx", F.when(top, F.min("_up_r").over(ahead)).when(F.col("peak_sign").isNotNull(), F.min("_dn_r").over(ahead)))
    foot = {"_up_l": F.when(F.col("_up_l").isNotNull(), s), "_dn_l": F.when(F.col("_dn_l").isNotNull(), s), "_up_r": F.when(F.col("_up_r").isNotNull(), s), "_dn_r": F.when(F.col("_dn_r").isNotNull(), s)}
    out = out.withColumns(foot)
    # a stop's value is never null where a walk ends: walks stop before nulls
    out = out.withColumn("left_base", F.when(top, F.last("_up_l", True).over(back)).when(F.col("peak_sign").isNotNull(), F.last("_dn_l", True).over(back)))
    out = out.withColumn("right_base", F.when(top, F.last("_up_r", True).over(ahead)).when(F.col("peak_sign").isNotNull(), F.last("_dn_r", True).over(ahead)))
    out = out.drop(*stops)
    rise, fall = F.greatest(F.col("idx") - F.col("left_idx"), F.lit(1)), F.greatest(F.col("right_idx") - F.col("idx"), F.lit(1))
    prominence = F.when(top, s - F.greatest("left_base", "right_base")).when(F.col("peak_sign").isNotNull(), F.least("left_base", "right_base") - s)
    return out.withColumns(
        {
            "prominence": F.greatest(prominence, F.when(F.col("peak_sign").isNotNull(), F.lit(0.0))),
            "width": F.greatest(F.col("right_idx") - F.col("left_idx"), F.when(F.col("peak_sign").isNotNull(), F.lit(1))).cast("double"),
            "rise_slope": F.abs((s - F.col("left_base")) / rise),
            "fall_slope": F.abs((s - F.col("right_base")) / fall),
            "asymmetry": F.when(F.col("peak_sign").isNotNull(), rise / fall),
        }
    )


def peaks(sig: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Peak events: keys, idx, ts, sign, value, prominence, width, slopes, asymmetry, bases and their places."""
    out = with_peaks(sig, keys).filter("peak_sign is not null")
    return out.select(*keys, "idx", "ts", F.col("peak_sign").alias("sign"), F.col("s").alias("value"), "prominence", "width", "rise_slope", "fall_slope", "asymmetry", "left_base", "right_base", "left_idx", "right_idx")
