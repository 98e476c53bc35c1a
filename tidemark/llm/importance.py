"""Target-distribution importance resampling: draw the documents that look most like a target corpus.

A document's weight is the mean gain of its hashed n-grams, the log ratio of their shares in the target and in all
documents, looked up in an array. A Gumbel number drawn from its id is added, and the highest sums are drawn without
replacement. The cutoff is found without sorting all scores: a quantile sketch gives a bracket, exact counts outside it say
whether the cutoff lies inside, and only then the rows in the bracket are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import written
from tidemark.llm.terms import terms
from tidemark.llm.words import slices

SCORED = "id long, n_features long, weight long, score long"


def buckets(text: bytes | None, size: int, n_buckets: int) -> Iterator[np.ndarray]:
    """The bucket of each feature (each run of 1 to size consecutive terms) of a text."""
    before: deque[bytes] = deque(maxlen=max(size - 1, 0) or None)
    for some in terms(text):
        yield np.array([zlib.crc32(w) % n_buckets for w in some], np.int64)
        if size > 1:  # runs that end in this list, some of which start before it
            row, old = [*before, *some], len(before)
            for n in range(2, size + 1):
                yield np.array([zlib.crc32(b" ".join(row[i - n + 1 : i + 1])) % n_buckets for i in range(max(old, n - 1), len(row))], np.int64)
            before.extend(some)


def _counted(size: int, n_buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for b in batches:
            for text in b.column(0).cast(pa.large_binary()):
                for x in buckets(text.as_py(), size, n_buckets):
                    total += np.bincount(x, minlength=n_buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return run


def counts(df: DataFrame, text_col: str, size: int, n_buckets: int) -> list[int]:
    """How often each bucket occurs in all texts; a row for each bucket comes to the driver."""
    each = df.select(F.col(f"`{text_col}`").alias("text")).filter("text is not null").mapInArrow(_counted(size, n_buckets), "bucket long, n long")
    out = [0] * n_buckets
    for r in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares, for each bucket."""
    n, s_all, t_all = len(source), sum(source), sum(target)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source, target, strict=True)], np.int64)


def _weighed(gain: np.ndarray, size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole, 1)):
            n_all, weight = [], []
            for text in b.column(1).cast(pa.large_binary()):
                n = total = 0
                for x in buckets(text.as_py(), size, len(gain)):
                    n, total = n + len(x), total + int(gain[x].sum())
                n_all.append(n)
                weight.append(total // n if n else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_all, pa.int64()), pa.array(weight, pa.int64())], ["id", "n_features", "weight"])

    return run


def gumbel(id_col: str, seed: str) -> Column:
    """1000 times a Gumbel number drawn from the id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def numbered(df: DataFrame) -> DataFrame:
    """Rows by falling score, id and row with their place, from 1: ranges are sorted by themselves, and only their sizes come to the driver."""
    order = (F.desc("score"), F.asc_nulls_first("id"), F.asc("row"))
    ranges = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("local", F.monotonically_increasing_id()))
    part, place = F.shiftright("local", 33), F.col("local").bitwiseAND((1 << 33) - 1)
    offsets, at = [], 0
    for r in sorted(ranges.groupBy(part.alias("part")).count().collect()):
        offsets.append((r["part"], at))
        at += r["count"]
    shift = df.sparkSession.createDataFrame(offsets, "part long, shift long")
    return ranges.withColumn("part", part).join(F.broadcast(shift), "part").withColumn("place", place + F.col("shift") + 1).drop("part", "shift", "local")


def bracket(rows: DataFrame, n_rows: int, take: int, width: float = 0.002, accuracy: int = 2000) -> tuple[int, int, int]:
    """Scores (low, high) that hold the take-th highest one between them, and the exact number of rows above high.

    The sketch's bracket is checked by counting all rows above and inside; while the place isn't inside it is widened fourfold.
    """
    while True:
        share = 1 - take / n_rows
        at = [max(share - width, 0.0), min(share + width, 1.0)]
        if at == [0.0, 1.0]:
            low, high = rows.agg(F.min("score"), F.max("score")).first()
        else:
            low, high = rows.agg(F.percentile_approx("score", at, accuracy)).first()[0]
        above, inside = rows.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < take <= above + inside:
            return low, high, above
        width *= 4


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, size: int = 1, n_buckets: int = 10_000, least: int = 20, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """One row per input row: id_col, n_features, weight, score, rank (null unless drawn).

    Of the N rows with at least ``least`` words, floor(percent * N / 100) are drawn: those of the highest scores, ties to
    the smaller id (null first), then to the earlier row. Null and empty texts have no feature and weight 0, and are never
    drawn unless least is 0. Rows that repeat are counted, weighed and drawn each. An empty target gives gains of smoothed shares alone;
    an empty table an empty result. Only the named columns are read.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    gain = gains(counts(docs, text_col, size, n_buckets), counts(target, target_col, size, n_buckets))
    weighed = src.mapInArrow(_weighed(gain, size), "id long, n_features long, weight long")
    rows = written(weighed.withColumn("score", F.col("weight") + gumbel("id", seed)).withColumn("row", F.monotonically_increasing_id()))
    # a text of w words has w + (w - 1) + ... features
    enough = sum(max(least - n, 0) for n in range(size))
    fit = rows.filter(F.col("n_features") >= enough)
    n_fit = fit.count()
    take = percent * n_fit // 100
    if not take:
        return rows.drop("row").withColumn("rank", F.lit(None).cast("long")).withColumnRenamed("id", id_col)
    low, high, above = bracket(fit, n_fit, take)
    cut = numbered(fit.filter(F.col("score").between(low, high))).filter(F.col("place") == take - above).first()
    score, id_, row = (F.lit(cut[c]).cast("long") for c in ("score", "id", "row"))
    at_least = (F.col("score") > score) | (F.col("score") == score) & (
        (F.col("id").isNull() & id_.isNotNull()) | (F.col("id") < id_) | F.col("id").eqNullSafe(id_) & (F.col("row") <= row)
    )
    drawn = F.coalesce((F.col("n_features") >= enough) & at_least, F.lit(False))
    ranked = numbered(rows.filter(drawn)).withColumnRenamed("place", "rank")
    out = ranked.unionByName(rows.filter(~drawn).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
