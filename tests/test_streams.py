"""Streams against the same operators on tables, over restarts, replays and late rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_operators import table
from tidemark.functions import equations
from tidemark.operators import segments
from tidemark.streaming import grid as streams
from tidemark.streaming import segments as stream_segments

COLUMNS = ["channel", "segment_id", "start_idx", "end_idx", "duration", "eq_type", "n_points"]


def run(df, out, checkpoint):
    with stream_segments.state_store(df.sparkSession):
        q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    return q


def two_series(spark, n=700):
    rng = np.random.default_rng(0)
    rows = [(c, i, None if rng.random() < 0.02 else float(x)) for c in "ab" for i, x in enumerate(np.cumsum(rng.normal(size=n)))]
    return spark.createDataFrame(rows, "channel string, idx long, x double")


def test_streamed_segments_over_restarts(spark, tmp_path):
    """Portions of any size, each by a query started anew: the closed segments are those of the whole series."""
    series = two_series(spark)
    want = segments.segmented(series, tolerance=3.0)
    last = want.groupBy("channel").agg(F.max("segment_id").alias("segment_id"))
    want = sorted(map(tuple, want.join(last, ["channel", "segment_id"], "left_anti").select(*COLUMNS).collect()))
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    for a, z in ((0, 10), (10, 23), (23, 200), (200, 201), (201, 555), (555, 700)):
        series.filter(F.col("idx").between(a, z - 1)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(series.schema).parquet(source)
        run(stream_segments.closed_segments(stream, 3.0), out, checkpoint)
        so_far = spark.read.parquet(out)
        assert so_far.filter(F.col("end_idx") >= z).count() == 0
    assert len(want) > 20 and sorted(map(tuple, so_far.select(*COLUMNS).collect())) == want
    fits = {(r.channel, r.segment_id): (r.L, r.rms, r.x0) for r in so_far.collect()}
    for r in segments.segmented(series, tolerance=3.0).collect():
        if (r.channel, r.segment_id) in fits:
            assert np.allclose(fits[r.channel, r.segment_id], (r.L, r.rms, r.x0), rtol=1e-6, atol=1e-9, equal_nan=True)


def test_streamed_segments_leave_out_late_rows(spark, tmp_path):
    series = two_series(spark, 300)
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    odd = series.filter("idx < 150").withColumn("x", F.lit(1e6))
    for part in (series.filter("idx < 200"), odd.unionByName(series.filter("idx >= 200")).unionByName(spark.createDataFrame([("a", None, 5.0)], series.schema))):
        part.coalesce(1).write.mode("append").parquet(source)
        run(stream_segments.closed_segments(spark.readStream.schema(series.schema).parquet(source), 3.0), out, checkpoint)
    want = segments.segmented(series, tolerance=3.0)
    got = {tuple(r) for r in spark.read.parquet(out).select(*COLUMNS).collect()}
    every = {tuple(r) for r in want.select(*COLUMNS).collect()}
    assert got <= every and len(every) - len(got) == 2


def test_segments_by_time(spark, tmp_path):
    series = table(spark, np.cumsum(np.random.default_rng(1).normal(size=200)).tolist())
    series.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(series.schema).parquet(str(tmp_path / "in"))
    run(stream_segments.closed_segments(stream, 2.0, order="ts"), str(tmp_path / "out"), str(tmp_path / "check"))
    starts = {r.idx: r.t for r in series.select("idx", F.col("ts").cast("timestamp").alias("t")).collect()}
    want = [(r.segment_id, starts[r.start_idx], starts[r.end_idx]) for r in segments.segmented(series, tolerance=2.0).orderBy("segment_id").collect()]
    got = sorted((r.segment_id, r.start_idx, r.end_idx) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == want[:-1]


@pytest.mark.parametrize("portions", [[1] * 300, [7, 100, 193], [300]])
def test_a_walk_in_portions(portions):
    y = np.cumsum(np.random.default_rng(3).normal(size=300))
    y[50:60] = np.nan
    whole, parts, at = equations.Walk(2.0).feed(y, last=True), equations.Walk(2.0), 0
    got = []
    for n in portions:
        got += parts.feed(y[at : at + n])
        at += n
    got += parts.feed(y[:0], last=True)
    assert [(a, z, f.eq_type, f.n_points) for a, z, f in got] == [(a, z, f.eq_type, f.n_points) for a, z, f in whole]
    assert equations.Walk(1.0).feed(y[:0], last=True) == [] and equations.Walk(1.0).feed(y[:3]) == []


def test_replayed_and_late_events(spark, tmp_path):
    """Events that are sent again, in the same file or a later one, count once; rows behind the watermark are counted."""
    schema = "event_id long, ts timestamp, event_type string, value double"
    first = [(i, f"2024-01-01 {i // 10:02d}:{i % 10 * 5:02d}:00", "ab"[i % 2], float(i)) for i in range(60)]
    later = [*first[45:], *((i, f"2024-01-01 {i // 10:02d}:{i % 10 * 5:02d}:00", "ab"[i % 2], float(i)) for i in range(60, 120)), (999, None, "a", 1.0)]
    late = [(500, "2024-01-01 00:10:00", "a", 1e9), (501, "2024-01-01 00:20:00", "b", 1e9), (502, "2024-01-01 20:00:00", "a", 0.0)]
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    progress = []
    for rows in ([*first, *first[:7]], later, late):
        spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        q = streams.hourly(stream, ids=("event_id",)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        progress += [p if isinstance(p, dict) else __import__("json").loads(p.json) for p in q.recentProgress]
    want = {}
    for i in range(120):
        want.setdefault(("ab"[i % 2], i // 10), []).append(float(i))
    got = {(r.channel, r.ts.hour): r.x for r in spark.read.parquet(out).collect()}
    assert got == {k: np.mean(v) for k, v in want.items()}
    assert streams.late_rows(progress) == 2
