import json

import pytest

from tidemark.config import COLUMNS, Config
from tidemark.sources import observations, sinks
from tidemark.streaming import grid as stream

ROWS = ["01-jan-2020 00:00,0,0.1,0,5.5,0,4.0,3.0,8.0,80,1010.5,1,12,2,270,1,1,0,10,5,7", "01-jan-2020 01:00,,0.2,3, ,0,x,3.0,8.0,NaN,1011,0,13,0,280"]


def write(tmp_path, lines, name="a.csv"):
    p = tmp_path / name
    p.write_text("\n".join(lines) + "\n")
    return str(p)


def test_preamble_masks_and_duplicates(spark, tmp_path):
    p = write(tmp_path, ["Station: X", "any text, with commas", "Date,ind,rain", *ROWS, "bad time,1", ROWS[0].replace("5.5", "9.9"), ""])
    got = observations.read_observations(spark, p).orderBy("ts").collect()
    assert len(got) == 2 and got[0].temperature == 5.5 and got[0].wind_speed == 12.0
    assert got[1].rainfall is None and got[1].temperature is None and got[1].wet_bulb is None and got[1].relative_humidity is None and got[1].pressure == 1011.0
    assert observations.read_observations(spark, p, mask=False).orderBy("ts").collect()[1].rainfall == 0.2
    assert [r.line for r in observations.read_preamble(spark, p).orderBy("n").collect()] == ["Station: X", "any text, with commas"]


def test_no_header(spark, tmp_path):
    with pytest.raises(Exception, match="no table header"):
        observations.read_raw(spark, write(tmp_path, ROWS)).count()


def test_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, None], float("nan")), (2, None, 2.0)], "id long, ids array<long>, x double")
    sinks.write_json_lines(df, str(tmp_path / "j"))
    back = observations.read_json_lines(spark, str(tmp_path / "j"), "id long, ids array<long>, x double")
    assert sorted((r.id, r.x) for r in back.collect()) == [(1, None), (2, 2.0)]
    assert [r.ids for r in sinks.flat(df).orderBy("id").collect()] == ["1,", ""]
    (tmp_path / "a.json").write_text('[{"id": 1}, {"id": 2}]')
    assert observations.read_json_array(spark, str(tmp_path / "a.json"), "id long").count() == 2
    (tmp_path / "t.jsonl.gz").write_bytes(b"")
    assert observations.existing(spark, str(tmp_path / "t.jsonl")).endswith(".gz")


def test_summaries(spark, tmp_path):
    s = sinks.write_summary(spark.range(3).selectExpr("count(*) as n", "double('nan') as x"), str(tmp_path / "s.json"))
    assert s == {"n": 3, "x": None} == json.loads((tmp_path / "s.json").read_text())
    assert sinks.write_manifest(spark, str(tmp_path / "m.json"), Config())["config"]["smooth"] == 5
    assert sinks.write_bundle({"a": spark.range(4)}, str(tmp_path / "b")) == {"a": 4}
    sinks.write_csv(spark.range(2), str(tmp_path / "c"))
    assert len(COLUMNS) == 21


def test_stream_gives_the_batch_hours(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    hours = stream.hourly(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
    q = hours.writeStream.format("parquet").option("path", str(tmp_path / "hours")).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    table = spark.read.parquet(str(tmp_path / "hours"))
    q = stream.extrema(spark.readStream.schema(table.schema).parquet(str(tmp_path / "hours"))).writeStream.format("memory").queryName("turns").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    closed = stream.hourly(e).filter(f"ts + interval 3 hours <= timestamp'{e.agg({'ts': 'max'}).first()[0]}'")
    assert table.count() == closed.count() > 0
    assert spark.table("turns").count() > 0
    assert set(spark.table("turns").columns) == {"channel", "ts", "sign", "amplitude", "first_diff"}
    assert stream.hourly(e).count() == e.selectExpr("event_type", "date_trunc('hour', ts) h").distinct().count()


def test_prepare_discover_samples(spark, data):
    from tidemark.operators import signal
    from tidemark.plans import catalog, pipeline

    g = signal.hourly_grid(spark.read.parquet(f"{data}/events.parquet")).filter("idx < 120")
    p = pipeline.prepare(g, list(catalog.channels(catalog.grid(spark, data))), compound=("purchase", "view"))
    n = p.vectors.count()
    assert n == 97 and len(p.vectors.first().v) == 26 * 5 + 3 * 10
    labels, protos = pipeline.discover(p, least=3, sample_size=97)
    assert labels.count() == n and protos.count() >= 1
    assert pipeline.sequence_samples(p, labels).count() == n - 3 - 47
    target = p.intra.filter("channel = 'click'").selectExpr("window_id - 1 as window_id", "current_value as y")
    w, _ = pipeline.ridge_forecast(p.vectors, target)
    assert len(w) == 160
