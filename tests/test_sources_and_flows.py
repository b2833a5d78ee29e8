import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fiberlake.plans import flows
from fiberlake.sources import files as fi
from fiberlake.sources import records as rec
from fiberlake.sources.npy import NpyDataSource, decode_files
from fiberlake.streaming import sta_lta as sl

from .test_operators import T0, route, waveform


def test_cable_json(spark, tmp_path):
    path = tmp_path / "cable.json"
    path.write_text(json.dumps({"positions": {"12": {"lat": 1.0, "lon": 2.0, "depth": 3.0}, "2": {"lat": 4.0, "lon": 5.0, "depth": 6.0}}, "metadata": {"fs": 400, "dx": 2.04}}))
    rows, meta = rec.read_cable(spark, str(path))
    assert [(r.channel_id, r.pos, r.depth) for r in rows.orderBy("pos").collect()] == [(2, 0, 6.0), (12, 1, 3.0)]
    assert {r.name: r.value for r in meta.collect()} == {"fs": 400.0, "dx": 2.04}


def test_reports(spark, tmp_path):
    path = tmp_path / "ais.csv"
    path.write_text("# Timestamp,Type of mobile,MMSI,Latitude,Longitude,SOG,Extra\n01/01/2025 07:59:59,Class A,111,55.1,11.0,3.5,x\n01/01/2025 08:00:00,Class A,222,55.1,11.0,,y\n01/01/2025 08:01:00,Class A,444,55.1,11.0,1,z\n")
    rows = rec.read_reports(spark, str(path))
    assert rows.columns[0] == "Timestamp" and [r.MMSI for r in rows.filter("Timestamp >= '2025-01-01 08:00:00' and Timestamp < '2025-01-01 08:01:00'").collect()] == [222]
    rec.write_reports_by_hour(rows, str(tmp_path / "hours"))
    hour = spark.read.parquet(str(tmp_path / "hours")).filter("hour = 7")
    assert hour.count() == 1 and "PartitionFilters: [isnotnull(hour" in hour._jdf.queryExecution().toString()


def test_files_and_npy(spark, tmp_path):
    arrays = {"080010": np.arange(50, dtype=np.int16).reshape(10, 5), "080000": np.ones((10, 5), np.int16), "080020": np.ones((3, 5), np.int16)}
    for name, x in arrays.items():
        np.save(tmp_path / f"{name}.npy", x)
    index = fi.index_files(spark, [str(tmp_path)], "2025-01-01").orderBy("file_ts").collect()
    assert [r.file_ts for r in index] == [datetime(2025, 1, 1, 8), datetime(2025, 1, 1, 8, 0, 10)]
    with pytest.raises(FileNotFoundError):
        fi.index_files(spark, [str(tmp_path)], "2025-01-01", "*.xyz")
    spark.dataSource.register(NpyDataSource)
    rows = spark.read.format("npy").option("path", f"{tmp_path}/080010.npy").option("date", "2025-01-01").option("channels", "1,4").load().collect()
    assert {r.channel: r.samples for r in rows} == {c: arrays["080010"][:, c].astype(float).tolist() for c in (1, 4)} and rows[0].file_ts == datetime(2025, 1, 1, 8, 0, 10)
    whole = spark.read.format("npy").option("path", str(tmp_path)).option("date", "2025-01-01").load()
    assert whole.count() == 15
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "0800[01]0.npy").load(str(tmp_path))
    same = decode_files(raw, "2025-01-01", [1, 4]).filter("file like '%080010%'").collect()
    assert {r.channel: r.samples for r in same} == {r.channel: r.samples for r in rows}


def test_annotation_files(spark, tmp_path):
    rows = [("a", T0, 0, 1.5), ("a", T0, 1, 999999.0), ("b", T0 + timedelta(seconds=1), 0, 2.0)]
    df = spark.createDataFrame(rows, "file string, center_time timestamp_ntz, channel int, distance_m double")
    rec.save_annotations(df, str(tmp_path / "ann"))
    assert sorted(map(tuple, rec.load_annotations(spark, str(tmp_path / "ann")).collect())) == sorted(rows)
    rec.write_offset(spark.createDataFrame([(1.0, 2.0, "x", 2.2, 3)], rec.OFFSET), str(tmp_path / "off"))
    assert rec.read_offset(spark, str(tmp_path / "off")).first().label == "x"
    rec.write_table(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3


def test_streaming_sta_lta_equals_batch(spark, tmp_path):
    from fiberlake.operators import detect as de

    rng = np.random.default_rng(0)
    x = rng.random((60, 3)) + 1
    rows = [(c, t, float(x[t, c])) for t in range(60) for c in range(3)]
    schema = "channel int, seq long, value double"
    for part in range(4):
        spark.createDataFrame([r for r in rows if r[1] // 15 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/p{part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = sl.sta_lta(stream, 4, 20).writeStream.format("memory").queryName("ratios").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = {(r.channel, r.seq): r.ratio for r in spark.table("ratios").collect()}
    finally:
        q.stop()
    batch = de.sta_lta_ratio(spark.createDataFrame(rows, schema).withColumnRenamed("seq", "t"), 4, 20)
    want = {(r.channel, r.t): r.ratio for r in batch.collect()}
    assert got.keys() == want.keys()
    assert all((got[i] is None) == (want[i] is None) and (want[i] is None or abs(got[i] - want[i]) < 1e-12) for i in want)


def test_streaming_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    found = {}
    for name, f in (("tumbling", sl.tumbling_counts), ("sessions", sl.session_counts)):
        q = f(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        try:
            q.processAllAvailable()
            found[name] = spark.table(name).count()
        finally:
            q.stop()
    windows = events.groupBy(F.window("ts", "6 hours"), "event_type").count()
    # windows that the watermark has closed
    assert 0 < found["tumbling"] <= windows.count() and found["sessions"] > 0


def test_flows(spark):
    fs, rng = 50.0, np.random.default_rng(1)
    cable = route(spark, 30)
    p = {r.pos: r for r in cable.collect()}
    files = [rng.normal(0, 1, (500, 30)) for _ in range(6)]
    for i in (1, 4):
        files[i][:, 14:17] += 60 * np.sin(2 * np.pi * 6 * np.arange(500) / fs)[:, None]
    wave = waveform(spark, files)
    rows = [(i, "Class A", 100 + i, T0 + timedelta(seconds=10 * f + 5), p[15].lat + 0.0002, p[15].lon, 5.0) for i, f in enumerate((1, 4))]
    rows += [(9, "Class A", 7, T0 + timedelta(seconds=25), p[3].lat + 0.01, p[3].lon, 5.0)]
    ais = spark.createDataFrame(rows, "ord int, `Type of mobile` string, MMSI long, Timestamp timestamp_ntz, Latitude double, Longitude double, SOG double")
    winner, sweeps = flows.cable_offset(wave, cable, ais, fs, 2.0, [(4.0, 8.0), (10.0, 20.0)], [6.0], [20.0, 40.0], (0.0, 1e4))
    assert sweeps.count() == 6 and winner.count() == 1
    table = flows.detect_and_evaluate(wave.filter("file in ('f0', 'f2', 'f3')"), wave, cable, ais, fs, 3, 2.0, [50.0, 500.0]).collect()
    assert [r.range_m for r in sorted(table, key=lambda r: r.range_m)] == [50.0, 500.0]
    scores = flows.benchmark_all(wave, cable, ais, fs, 3, 3, [-0.5, 0.5], [50.0, 200.0], [6.0]).collect()
    assert len(scores) == 5 * 2 and {r.method for r in scores} == {"fixed threshold", "temporal z", "STA/LTA band", "STA/LTA wavelet 6 Hz", "Radon"}
    from fiberlake.operators import annotate as an

    notes = an.build_annotations(wave.select("file", "file_ts").distinct(), ais, cable, "ord", time_tol_s=6.0)
    features = flows.ship_psd_features(wave, notes, fs, [0.0, 5.0, 10.0, 25.0], 300.0, 2000.0).collect()
    assert {r.label for r in features} == {"ship", "noise"}
    assert all(abs(r.dominant_freq_hz - 6) < 0.2 for r in features if r.label == "ship" and r.file in ("f1", "f4"))
