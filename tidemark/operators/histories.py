"""Segments before and after centres: ranges of places first, vectors on demand.

A centre's tail holds the segments that start in [centre - half, centre), its head those in [centre, centre + half); of the
tail the last ``most`` count, of the head the first. Segments are numbered by start once, so that a tail or head is a range of
numbers found by as-of lookups: rows grow with centres, not with centres times segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.samples import forward_asof, numbered


def centres(segments: DataFrame, half: int, step: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every ``step`` steps a centre, from half after the first start to half before the last."""
    ends = segments.groupBy(*keys).agg(F.min("start_idx").alias("a"), F.max("start_idx").alias("z")).filter(F.col("z") - F.col("a") >= 2 * half)
    return ends.select(*keys, F.explode(F.sequence(F.col("a") + half, F.col("z") - half, F.lit(step).cast("long"))).alias("centre"))


def around(segments: DataFrame, at: DataFrame, half: int = 1080, most: int = 256, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, centre, and the places [tail_from, tail_to) and [head_from, head_to) of its segments in the order of starts."""
    placed = numbered(segments.select(*keys, "start_idx"), "start_idx", keys)
    total = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    asks = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("centre") + s).alias("at")) for k, s in enumerate((-half, 0, half))])
    asked = at.select(*keys, "centre", F.explode(asks).alias("q")).select(*keys, "centre", "q.k", "q.at")
    # of equal starts the first place is the one at or after a time
    firsts = placed.groupBy(*keys, "start_idx").agg(F.min("pos").alias("pos"))
    found = forward_asof(asked, firsts, "at", "start_idx", "pos", keys)
    found = (found.join(total, list(keys)) if keys else found.join(F.broadcast(total))).withColumn("pos", F.coalesce("pos", "_all"))
    a, b, c = (F.max(F.when(F.col("k") == k, F.col("pos"))) for k in range(3))
    out = found.groupBy(*keys, "centre").agg(a.alias("a"), b.alias("tail_to"), c.alias("c"))
    return out.select(*keys, "centre", F.greatest("a", F.col("tail_to") - most).alias("tail_from"), "tail_to", F.col("tail_to").alias("head_from"), F.least("c", F.col("tail_to") + most).alias("head_to"))


def members(ranges: DataFrame, segments: DataFrame, side: str = "tail", most: int = 256, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, centre, slot and the segments' columns: tails fill their slots up to the last, heads from the first."""
    placed = numbered(segments, "start_idx", keys)
    a, z = F.col(f"{side}_from"), F.col(f"{side}_to")
    each = ranges.filter(z > a).select(*keys, "centre", F.explode(F.sequence(a, z - 1)).alias("pos"), a.alias("_a"), z.alias("_z"))
    slot = F.col("pos") - F.col("_z") + most if side == "tail" else F.col("pos") - F.col("_a")
    return each.withColumn("slot", slot).drop("_a", "_z").join(placed, [*keys, "pos"]).drop("pos")


def last_before(segments: DataFrame, centre: int, half: int = 1080, most: int = 256) -> DataFrame:
    """The tail of one centre: at most ``most`` rows, in order."""
    inside = segments.filter((F.col("start_idx") >= centre - half) & (F.col("start_idx") < centre))
    return inside.orderBy(F.desc("start_idx")).limit(most).orderBy("start_idx")
