"""Exact quantiles of many values for few keys, without a task that gets all of a key's values.

Sketches give a bracket around each quantile, exact counts say on which side of it the quantile lies, and so on until a
bracket holds few rows. Only these are ordered. Sketches bear on the work, not on the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bracket may hold when it is ordered.
FEW = 1_000_000
#: Of the sketches, and half of a bracket's width in ranks, as a share of the rows in hand.
ACCURACY, WIDTH = 2000, 0.002
ROUNDS = 8


def exact_quantiles(values: DataFrame, probs: Sequence[float], key: str = "key", value: str = "x") -> DataFrame:
    """key and q, the quantiles at ``probs`` by linear interpolation, as percentile() gives them; keys without values are left
    out. Keys, which are few, and their brackets pass through the driver.
    """
    spark = values.sparkSession
    kind = values.schema[key].dataType.simpleString()
    rows = values.filter(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(value).cast("double").alias("x"))
    around = lambda s, half: [min(1.0, max(0.0, s + e)) for e in (-half, half)]
    sketch = lambda ends: F.percentile_approx("x", F.array(*map(F.lit, ends)), ACCURACY).alias("ends")
    ends = [e for p in probs for e in around(p, WIDTH)]
    totals = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), sketch(ends)).collect()  # keys
    bounds = {(r["key"], i): r["ends"][2 * i : 2 * i + 2] for r in totals for i in range(len(probs))}
    # by key and place of prob: bounds (included; None: open), rows below them, rows within, wanted rank from 0
    now = {(r["key"], i): {"lo": None, "hi": None, "below": 0, "n": r["n"], "at": (r["n"] - 1) * p} for r in totals for i, p in enumerate(probs)}

    def within(some: dict) -> DataFrame:
        table = spark.createDataFrame([(k, i, b["lo"], b["hi"]) for (k, i), b in some.items()], f"key {kind}, i int, lo double, hi double")
        inside = (F.col("lo").isNull() | (F.col("x") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("x") <= F.col("hi")))
        return rows.join(F.broadcast(table), "key").filter(inside).select("key", "i", "x")

    for turn in range(ROUNDS):
        wide = {k: b for k, b in now.items() if b["n"] > FEW}
        if not wide:
            break
        if turn:
            pairs = {k: around((b["at"] - b["below"]) / b["n"], WIDTH * 2**turn) for k, b in wide.items()}
            ends = sorted({e for x in pairs.values() for e in x})
            found = {(r["key"], r["i"]): dict(zip(ends, r["ends"], strict=True)) for r in within(wide).groupBy("key", "i").agg(sketch(ends)).collect()}
            bounds = {k: [found[k][e] for e in x] for k, x in pairs.items()}
        table = spark.createDataFrame([(k, i, *x) for (k, i), x in bounds.items() if (k, i) in wide], f"key {kind}, i int, first double, last double")
        sides = within(wide).join(F.broadcast(table), ["key", "i"])
        sums = sides.groupBy("key", "i").agg(F.count_if(F.col("x") < F.col("first")).alias("less"), F.count_if((F.col("x") >= F.col("first")) & (F.col("x") <= F.col("last"))).alias("inside"))
        for r in sums.collect():  # keys
            k = (r["key"], r["i"])
            b, (first, last) = now[k], bounds[k]
            start, end = b["below"] + r["less"], b["below"] + r["less"] + r["inside"]
            if start <= math.floor(b["at"]) and math.ceil(b["at"]) < end:
                now[k] = b | {"lo": first, "hi": last, "below": start, "n": r["inside"]}
    table = spark.createDataFrame([(k, i, math.floor(b["at"]) - b["below"], math.ceil(b["at"]) - b["below"], b["at"]) for (k, i), b in now.items()], f"key {kind}, i int, low long, high long, at double")
    counts = within(now).groupBy("key", "i", "x").agg(F.count(F.lit(1)).alias("n"))
    seen = counts.withColumn("seen", F.sum("n").over(Window.partitionBy("key", "i").orderBy("x"))).join(F.broadcast(table), ["key", "i"])
    two = seen.groupBy("key", "i").agg(F.min(F.when(F.col("seen") > F.col("low"), F.col("x"))).alias("a"), F.min(F.when(F.col("seen") > F.col("high"), F.col("x"))).alias("b"), F.first("at").alias("at"))
    q = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil("at") - F.col("at")) * F.col("a") + (F.col("at") - F.floor("at")) * F.col("b"))
    each = two.select("key", F.struct("i", q.alias("q")).alias("q")).groupBy("key").agg(F.array_sort(F.collect_list("q")).alias("q"))
    return each.select(F.col("key").alias(key), F.transform("q", lambda r: r["q"]).alias("q"))
