"""Behaviours of the operators on small made-up inputs."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fiberlake.functions import columns as fc
from fiberlake.operators import ais as ai
from fiberlake.operators import annotate as an
from fiberlake.operators import augment as au
from fiberlake.operators import channels as ch
from fiberlake.operators import detect as de
from fiberlake.operators import evaluate as ev
from fiberlake.operators import geo, ml
from fiberlake.operators import image as im
from fiberlake.operators import offset as of
from fiberlake.operators import quality as qu
from fiberlake.operators import radon as ra
from fiberlake.operators import select as se
from fiberlake.operators import stats as st
from fiberlake.operators import transforms as tr
from fiberlake.operators.nearest import Tree, nearest

T0 = datetime(2025, 1, 1)
FS = 400.0


def image(spark, x):
    x = np.asarray(x, float)
    return spark.createDataFrame([(int(t), int(c), float(x[t, c])) for t in range(x.shape[0]) for c in range(x.shape[1])], "t long, channel int, value double")


def matrix(df, shape=None):
    rows = df.collect()
    out = np.full(shape or (max(r.t for r in rows) + 1, max(r.channel for r in rows) + 1), np.nan)
    for r in rows:
        out[r.t, r.channel] = r.value
    return out


def waveform(spark, files):
    """files: arrays (samples, channels), ten seconds apart."""
    rows = [(f"f{i}", T0 + timedelta(seconds=10 * i), c, x[:, c].astype(float).tolist()) for i, x in enumerate(files) for c in range(x.shape[1])]
    return spark.createDataFrame(rows, "file string, file_ts timestamp_ntz, channel int, samples array<double>").repartition(4)


def route(spark, n=200, spacing=2.0, lat=55.3):
    step = float(spacing / (111320 * np.cos(np.radians(lat))))
    return geo.positions_sorted(spark.createDataFrame([(10 * i, lat, 11 + i * step) for i in range(n)], "channel_id int, lat double, lon double"))


def test_stats_and_quality(spark):
    rng = np.random.default_rng(0)
    x = np.column_stack([np.full(100, 1e-6), 10 + rng.normal(0, 0.2, 100), np.full(100, 40000.0)])
    rows = {r.channel: r for r in st.channel_stats(image(spark, x), 16).collect()}
    assert rows[2].saturation_frac == 1 and rows[0].dropout_frac == 1 and rows[1].dropout_frac == 0
    assert abs(rows[1].dynamic_range - 1) < 0.2
    assert abs(rows[1].mad - 1.4826 * np.median(np.abs(x[:, 1] - np.median(x[:, 1])))) < 1e-9
    y = np.column_stack([10 + rng.normal(0, 0.2, (200, 3)), np.full(200, 1e-6), np.where(rng.random(200) < 0.3, 1000.0, 10.0)])
    kept = qu.select_persistent_channels(image(spark, y), (0.0, 1.0), 0.9, 0.0, 1.0).filter("keep").collect()
    assert {r.channel for r in kept} == {0, 1, 2}
    noise = {r.channel: r.noise for r in qu.measure_noise(image(spark, y), 16).collect()}
    assert noise[0] == 1 and noise[3] == 0 and 0 < noise[4] < 1
    base = {r.channel: r for r in st.channel_baseline(image(spark, np.full((20, 1), 3.0))).collect()}
    assert base[0].floor == 3 and base[0].scale == 3e-6


def test_correlations(spark):
    rng = np.random.default_rng(1)
    x = np.zeros((1500, 6))
    x[:, 0] = rng.standard_normal(1500)
    for c in range(1, 5):
        x[:, c] = 0.6 * x[:, c - 1] + 0.8 * rng.standard_normal(1500)
    x[:, 5] = 4.0
    df = image(spark, x)
    rho = {(r.i, r.j): r.rho for r in ch.correlation_matrix(df).collect()}
    assert abs(rho[0, 1] - np.corrcoef(x[:, 0], x[:, 1])[0, 1]) < 1e-9 and rho[2, 2] == pytest.approx(1) and rho[5, 5] == 0 and rho[0, 5] == 0
    assert ch.pair_correlation(df, 0, 1).first().rho == pytest.approx(rho[0, 1]) and ch.pair_correlation(df, 0, 5).first().rho == 0
    lags = {r.lag: r.rho for r in ch.neighbor_correlation(df.filter("channel < 5"), 6).collect()}
    assert abs(lags[1] - 0.6) < 0.1 and abs(lags[2] - 0.36) < 0.1 and lags[5] is None
    windows = ch.sliding_neighbor_correlation(df, 100, 1, 50).collect()
    assert sorted(r.center for r in windows) == list(range(50, 1451, 50))
    with pytest.raises(ValueError):
        ch.sliding_neighbor_correlation(df, 1)
    series = spark.createDataFrame([(10 * i, v) for i, v in enumerate([0.9, 0.9, 0.2, 0.1, 0.2, 0.8, None, 0.1])], "center long, rho double")
    runs = ch.low_correlation_intervals(series, 0.3, 2).collect()
    assert [(r.start, r.end, r.length) for r in runs] == [(20, 40, 3)] and abs(runs[0].mean_corr - 0.5 / 3) < 1e-12


def test_transforms(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(3, 2, (20, 6)) + np.arange(20)[:, None]
    x[:, 5] = 2.0
    df = image(spark, x)
    z = matrix(tr.normalize(df))
    assert np.allclose(z[:, :5].mean(0), 0) and np.allclose(z[:, :5].std(0), 1) and (z[:, 5] == 0).all()
    assert np.allclose(matrix(tr.normalize(df, "minmax"))[:, :5].max(0), 1)
    across = matrix(tr.normalize(df, "robust", 1))
    m = np.median(x, axis=1, keepdims=True)
    assert np.allclose(across, (x - m) / (1.4826 * np.median(np.abs(x - m), axis=1, keepdims=True)))
    with pytest.raises(ValueError):
        tr.normalize(df, "other")
    t = np.arange(20)
    line = lambda y: y - np.polyval(np.polyfit(t, y, 1), t)
    assert np.allclose(matrix(tr.detrend(df)), np.apply_along_axis(line, 0, x))
    pad = lambda k, n: [np.arange(max(0, i - k), min(n, i + k + 1)) for i in range(n)]
    assert np.allclose(matrix(tr.smooth_temporal(df, 2)), [x[i].mean(0) for i in pad(2, 20)])
    assert np.allclose(matrix(tr.smooth_spatial(df, 1)), np.stack([x[:, i].mean(1) for i in pad(1, 6)], 1))
    assert np.allclose(matrix(tr.decimate(df, 3)), x[:18].reshape(6, 3, 6).mean(1))
    assert np.allclose(matrix(tr.decimate(df, 4, 1)), x[:, :4].mean(1, keepdims=True))
    assert np.allclose(matrix(im.crop(df, -5, None, 1, -1)), x[-5:, 1:-1])
    for shift in (3, -4, 0, 23):
        want = np.zeros_like(x)
        s = shift % 20
        want[s:] = x[: 20 - s]
        assert np.allclose(matrix(tr.time_shift(df, shift)), want)
    window = matrix(tr.taper(image(spark, np.ones((11, 1))), 0.4))[:, 0]
    assert window[0] == window[-1] == 0 and (window[2:9] == 1).all() and window[1] == pytest.approx(0.5)
    assert (matrix(tr.taper(image(spark, np.ones((11, 1))), 0.0)) == 1).all()


def test_images(spark):
    rng = np.random.default_rng(3)
    files = [rng.normal(0, 10, (200, 5)) for _ in range(3)]
    wave = waveform(spark, files)
    for name, f in (("rms", lambda v: np.sqrt((v * v).mean(0))), ("std", lambda v: v.std(0)), ("mean", lambda v: v.mean(0)), ("abs_mean", lambda v: np.abs(v).mean(0)), ("max", lambda v: np.abs(v).max(0))):
        got = {(r.file, r.channel): r.value for r in im.build_image(wave, name).collect()}
        assert all(got[f"f{i}", c] == np.float32(f(x)[c]) or abs(got[f"f{i}", c] - f(x)[c]) < 1e-5 for i, x in enumerate(files) for c in range(5))
    with pytest.raises(ValueError):
        im.build_image(wave, "other")
    assert im.bandpass_energy_image(wave, FS).count() == 15


def test_geo_and_ais(spark):
    assert abs(spark.range(1).select(fc.local_xy(F.lit(56.0), F.lit(11.0), F.lit(55.0), F.lit(11.0))[1]).first()[0] - 111320) < 1e-6
    cable = route(spark)
    moved = geo.apply_translation(cable, 50.0, 800.0)
    pair = cable.alias("a").join(moved.alias("b"), F.col("a.pos") == F.col("b.pos"))
    d = pair.select(*fc.offset_m(F.col("b.lat"), F.col("b.lon"), F.col("a.lat"), F.col("a.lon"))).first()
    assert abs(d[0] - 50) < 1e-6 and abs(d[1] - 800) < 0.5
    rows = [(0, "Class A", 1, 0, 5.0, 20), (1, "Class A", 1, 0, 5.0, 25), (2, "Base", 2, 0, 5.0, 20), (3, "Class B", 3, 0, 0.5, 90), (4, "Class A", 4, 0, 5.0, 20)]
    reports = cable.select("lat", F.col("pos").cast("int").alias("p"), F.col("lon")).join(spark.createDataFrame(rows, "ord int, kind string, MMSI long, s int, SOG double, p int"), "p")
    reports = reports.select("ord", F.col("kind").alias("Type of mobile"), "MMSI", F.lit(T0).cast("timestamp_ntz").alias("Timestamp"), (F.col("lat") + F.when(F.col("MMSI") == 4, 1.0).otherwise(0.001)).alias("Latitude"), F.col("lon").alias("Longitude"), "SOG")
    near = ai.near_route(reports, cable, "ord", 500.0).collect()
    assert sorted((r.ord, r.NearestId) for r in near) == [(0, 200), (3, 900)] and all(abs(r.DistToRoute_m - 111.32) < 1e-3 for r in near)
    assert [r.ord for r in ai.transiting(ai.near_route(reports, cable, "ord", 500.0)).collect()] == [0]


def brute_nearest(points, x, y):
    away = np.sqrt((x - points[:, 1]) ** 2 + (y - points[:, 2]) ** 2)
    return min(zip(away.tolist(), points[:, 0].astype(int).tolist(), strict=True))


def test_nearest_tree():
    rng = np.random.default_rng(10)
    for n in (1, 16, 17, 40, 1000):
        points = np.column_stack([rng.permutation(n), rng.integers(0, 30, n), rng.integers(0, 30, n)]).astype(float)  # ties and repeated places
        tree = Tree(*points.T)
        px, py = rng.integers(-20, 80, 500) / 2, rng.integers(-20, 80, 500) / 2
        assert [*zip(*(v.tolist() for v in tree.search(px, py)), strict=True)] == [brute_nearest(points, x, y) for x, y in zip(px, py, strict=True)]
    assert tree.search(np.array([np.nan, np.inf]), np.array([0.0, 0.0]))[1].tolist() == [-1, -1]
    assert Tree(*np.zeros((3, 0))).search(np.zeros(2), np.zeros(2))[1].tolist() == [-1, -1]


@pytest.mark.parametrize("held, block", [(1000, 1000), (0, 7)])
def test_nearest_of_a_table(spark, held, block):
    rng = np.random.default_rng(11)
    points = np.column_stack([np.arange(60), rng.integers(0, 40, 60), rng.integers(0, 40, 60)])
    table = spark.createDataFrame([(int(p), float(x), float(y)) for p, x, y in points] + [(60, None, 1.0)], "pos long, x double, y double")
    probes = [(i, float(rng.integers(-10, 50)), float(rng.integers(-10, 50))) for i in range(300)] + [(300, None, 1.0), (300, 2.0, None)]
    df = spark.createDataFrame(probes, "pos int, x double, y double").withColumnRenamed("pos", "i")
    got = sorted(((r.i, r.dist_m, r.pos) for r in nearest(df, table, "x", "y", held, block).collect()), key=str)
    want = [(i, *(brute_nearest(points.astype(float), x, y) if None not in (x, y) else (None, None))) for i, x, y in probes]
    assert got == sorted(want, key=str)
    assert {r.pos for r in nearest(df, table.filter("false"), "x", "y", max(held, 1), block).collect()} == {None}


def test_detect_stream_finds_a_ship(spark):
    rng = np.random.default_rng(4)
    quiet = [rng.normal(0, 1, (4000, 40)) for _ in range(2)]
    loud = [x.copy() for x in quiet]
    loud[1][200:3800, 20] += 40 * np.sin(2 * np.pi * 5 * np.arange(3600) / FS)
    base = st.channel_baseline(im.build_image(waveform(spark, quiet), "rms", FS, (1.0, 20.0)).select("channel", "value", F.lit(0).alias("t")))
    base = base.withColumn("scale", F.lit(0.05))
    found = de.detect_stream(waveform(spark, loud), base, FS, 5).collect()
    assert {r.channel for r in found} == {0, 5, 10, 15, 20, 25, 30, 35, 39} and len(found) == 2 * 9 * 10
    assert {(r.file, r.channel) for r in found if r.triggered} == {("f1", 20)}
    times = sorted({r.time_s for r in found})
    assert times[0] == pytest.approx(1.4) and times[1] - times[0] == pytest.approx(0.8)
    assert min(r.timestamp for r in found if r.file == "f1") == T0 + timedelta(seconds=11.4)
    with pytest.raises(ValueError):
        de.step_channels(waveform(spark, loud), 0)


def test_common_mode_and_corroboration(spark):
    rows = [("a", 0.0, c, True, T0) for c in range(4)] + [("b", 0.0, c, c == 1, T0) for c in range(4)]
    df = spark.createDataFrame(rows, "file string, time_s double, channel int, triggered boolean, timestamp timestamp_ntz")
    assert {(r.file, r.channel) for r in de.common_mode_suppression(df, 0.5).collect() if r.triggered} == {("b", 1)}
    rows = [("a", 400, 0, True), ("a", 425, 3, True), ("a", 700, 0, True), ("a", 700, 5, False), ("b", 410, 0, True), ("b", 410, 4, True), ("c", 1, 0, True), ("c", 2, 6, True)]
    df = spark.createDataFrame([(f, c, T0 + timedelta(seconds=s), t) for f, c, s, t in rows], "file string, channel int, timestamp timestamp_ntz, triggered boolean")
    kept = {(r.file, r.channel, r.timestamp) for r in de.spatial_corroboration(df, 50, 5.0).collect() if r.triggered}
    assert kept == {("a", 400, T0), ("a", 425, T0 + timedelta(seconds=3)), ("b", 410, T0), ("b", 410, T0 + timedelta(seconds=4))}


def test_clusters_match_a_global_greedy(spark):
    rng = np.random.default_rng(5)
    rows = [(T0 + timedelta(seconds=int(s)), int(c), float(z), bool(t)) for s, c, z, t in zip(rng.integers(0, 20_000, 800), rng.integers(0, 300, 800), rng.permutation(800), rng.random(800) < 0.9, strict=True)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, channel int, score double, triggered boolean")
    left, want = sorted((r for r in rows if r[3]), key=lambda r: -r[2]), []
    while left:
        seed = left[0]
        own = [r for r in left if abs((r[0] - seed[0]).total_seconds()) <= 60 and abs(r[1] - seed[1]) <= 50]
        want.append((seed[0], seed[1], seed[2], len(own)))
        left = [r for r in left if r not in own]
    got = [(r.timestamp, r.channel, r.score, r.n_members) for r in de.cluster_detections(df, 60.0, 50).collect()]
    assert sorted(got) == sorted(want)
    assert de.cluster_detections(df.filter("false")).count() == 0


def test_sta_lta(spark):
    x = np.concatenate([np.ones(100), np.full(20, 50.0)])[:, None]
    ratio = [r.ratio for r in de.sta_lta_ratio(image(spark, x), 4, 40).orderBy("t").collect()]
    assert ratio[:4] == [None] * 4 and ratio[50] == 1 and max(v for v in ratio if v) > 10
    rng = np.random.default_rng(6)
    files = [rng.normal(0, 1, (4000, 12)) for _ in range(4)]
    files[3][1000:, 5] += 30 * np.sin(2 * np.pi * 5 * np.arange(3000) / FS)
    found = de.sta_lta_stream(waveform(spark, files), FS, 5, sustain=0.2).collect()
    assert len(found) == 4 * 4 and {(r.file, r.channel) for r in found if r.triggered} == {("f3", 5)}
    wave = de.sta_lta_stream(waveform(spark, files), FS, 5, None, 5.0, sustain=0.2).collect()
    assert ("f3", 5) in {(r.file, r.channel) for r in wave if r.triggered}
    with pytest.raises(ValueError):
        de.sta_lta_stream(waveform(spark, files), FS, 5, None, None)


def test_radon(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(1, 0.2, (30, 21)) ** 2
    for c in range(21):
        x[10 + round(0.5 * c), c] += 20
    patch = image(spark, x).select("t", F.col("channel").alias("k"), "value")
    slow = [-1.0, -0.5, 0.5, 1.0]
    stack = ra.linear_radon_stack(patch, slow)
    best = ra.radon_score(stack).first()
    assert slow[best.si] == 0.5 and best.t0 == 10
    want = {(s, t): np.mean([x[t + round(k * slow[s]), k] for k in range(21)]) for s in range(4) for t in range(30) if all(0 <= t + round(k * slow[s]) < 30 for k in range(21))}
    got = {(r.si, r.t0): r.value for r in stack.collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    n = np.arange(4000)
    data = rng.normal(0, 1, (4000, 60))
    for c in range(60):
        data[:, c] += 30 * np.exp(-(((n - 1200 - 15 * (c - 20)) / 20) ** 2)) * np.sin(2 * np.pi * 8 * n / FS)
    found = ra.radon_detect_stream(waveform(spark, [data]), FS, 20, 10, [0.1 * k for k in range(2, 9)], 0.05).collect()
    assert {r.channel for r in found} == {0, 20, 40, 59} and next(r for r in found if r.channel == 20).triggered


def test_annotations(spark):
    cable = route(spark, 100)
    lat, lon = (cable.filter("pos = 40").first()[c] for c in ("lat", "lon"))
    ais = spark.createDataFrame([(0, 1, T0 + timedelta(seconds=5), lat + 0.001, lon), (1, 1, T0 + timedelta(seconds=20), lat + 1, lon), (2, 2, T0 + timedelta(seconds=100), lat, lon)], "ord int, MMSI long, Timestamp timestamp_ntz, Latitude double, Longitude double")
    files = spark.createDataFrame([("a", T0), ("b", T0 + timedelta(seconds=500))], "file string, file_ts timestamp_ntz")
    rows = an.build_annotations(files, ais, cable, "ord").collect()
    near = {r.channel: r.distance_m for r in rows if r.file == "a"}
    assert len(rows) == 200 and abs(near[40] - 111.3) < 0.051 and near[40] <= min(near.values()) + 0.11
    assert {r.distance_m for r in rows if r.file == "b"} == {999999.0} and rows[0].center_time in (T0 + timedelta(seconds=5), T0 + timedelta(seconds=505))
    by_file = an.annotate_files(files, ais, cable, "ord")
    assert {(r.file, c): d for r in by_file.collect() for c, d in enumerate(r.distances_m)} == {(r.file, r.channel): r.distance_m for r in rows}
    hits = spark.createDataFrame([(f, c, c % 3 == 0, c % 2) for f in "abz" for c in range(0, 104, 4)], "file string, channel int, triggered boolean, half int")
    both = [sorted(an.benchmark_detections(hits, a, [111.0, 200.0], ("half",)).collect()) for a in (by_file, an.build_annotations(files, ais, cable, "ord"))]
    assert both[0] == both[1] and len(both[0]) == 2
    ann = spark.createDataFrame([("a", c, d) for c, d in enumerate([10.0, 600.0, 2000.0, 5.0])], "file string, channel int, distance_m double")
    det = spark.createDataFrame([("a", c, t) for c, t in enumerate([True, False, False, True])] + [("z", 0, True)], "file string, channel int, triggered boolean")
    table = {r.range_m: r for r in an.benchmark_detections(det, ann, [100.0, 1000.0]).collect()}
    assert (table[100].tp, table[100].fp, table[100].fn, table[100].tn, table[100].f1) == (2, 0, 0, 2, 1.0)
    assert (table[1000].tp, table[1000].fn, table[1000].recall) == (2, 1, pytest.approx(2 / 3))
    empty = an.benchmark_detections(det.filter("false"), ann, [100.0]).first()
    assert (empty.tp, empty.accuracy, empty.precision, empty.f1) == (0, 0.0, 0.0, 0.0)


def test_evaluation(spark):
    cable = route(spark, 200)
    truth = spark.createDataFrame([(1, 50, T0), (2, 150, T0)], "gt_id long, channel int, timestamp timestamp_ntz")
    det = spark.createDataFrame([(0, 52, T0 + timedelta(seconds=5)), (1, 51, T0), (2, 148, T0 + timedelta(hours=1)), (3, 100, T0)], "det_id long, channel int, timestamp timestamp_ntz")
    matched, fp, fn = ev.match_detections(det, truth, cable, 50.0)
    assert [(r.det_id, r.gt_id, round(r.dist_m, 1)) for r in matched.collect()] == [(1, 1, 2.0)]
    assert {r.det_id for r in fp.collect()} == {0, 2, 3} and {r.gt_id for r in fn.collect()} == {2}
    table = {r.range_m: r for r in ev.evaluate_at_ranges(det, truth, cable, [1.0, 50.0]).collect()}
    assert (table[1].tp, table[50].tp, table[50].fp, table[50].fn) == (0, 1, 3, 1) and table[50].recall >= table[1].recall
    none = ev.match_detections(det, truth.filter("false"), cable, 50.0)
    assert none[0].count() == 0 and none[1].count() == 4


@pytest.mark.parametrize("north, east", [(35.0, 910.0), (-70.0, -420.0), (15.0, 0.0)])
def test_offset_recovery(spark, north, east):
    cable = route(spark, 2000)
    p = {r.pos: r for r in cable.collect()}
    true = [600, 900, 1200]
    x = np.ones((3, 2000))
    rows = []
    for i, c in enumerate(true):
        x[i, c] = 1000
        rows.append((i, p[c].lat + north / 111320, float(p[c].lon + east / (111320 * np.cos(np.radians(p[c].lat)))), T0 + timedelta(seconds=10 * i + 2)))
    cand = spark.createDataFrame(rows, "cand_id int, Latitude double, Longitude double, Timestamp timestamp_ntz")
    img = spark.createDataFrame([(t, c, float(x[t, c])) for t in range(3) for c in range(0, 2000)], "t long, channel int, value double").withColumn("bin_time", F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("t") * 10))
    sweep = {r.margin_m: r for r in of.margin_sensitivity(cand, img, cable, 2.0, [1500.0, 2000.0]).collect()}
    for r in sweep.values():
        assert abs(r.dlat_m - north) < 5 and abs(r.dlon_m - east) < 5
    assert abs(sweep[1500].dist_m - sweep[2000].dist_m) < 5


def test_selection(spark):
    corr = np.array([[1, 0.95, 0.1, 0.1], [0.95, 1, 0.1, 0.1], [0.1, 0.1, 1, 0.2], [0.1, 0.1, 0.2, 1.0]])
    assert se.greedy_decorrelated(corr, np.arange(4)).tolist() == [0, 2, 3]
    assert se.greedy_decorrelated(corr, np.arange(4), min_sep=3).tolist() == [0, 3]
    rng = np.random.default_rng(8)
    noise = rng.random(100)
    none = spark.createDataFrame([], "i int, j int, rho double")

    def table(scores):
        return spark.createDataFrame([(i, float(v)) for i, v in enumerate(scores)], "channel int, noise double")

    def channels(df):
        return sorted(r.channel for r in df.collect())

    pairs = spark.createDataFrame([(i, j, float(corr[i, j])) for i in range(4) for j in range(4)], "i int, j int, rho double")
    best = se.decorrelated(table([4, 3, 2, 1]), pairs).orderBy("place")
    assert [r.channel for r in best.collect()] == [0, 2, 3]
    assert [r.channel for r in se.decorrelated(table([1, 2, 2, 1]), pairs, min_sep=2).orderBy("place").collect()] == [1, 3]
    t = se.TargetSelector(table(noise), none)
    chosen = channels(t.select(min_sep=5, max_sep=30))
    assert np.diff(chosen).min() >= 5 and np.diff(chosen).max() <= 30
    ends = np.zeros(100)
    ends[[0, 99]] = 1
    filled = channels(se.TargetSelector(table(ends), none, [0, 99]).select(min_sep=0, max_sep=25))
    assert filled[0] == 0 and filled[-1] == 99 and np.diff(filled).max() <= 25
    assert t.select(max_count=7).count() == 7 and t.select(min_noise=2.0).count() == 0
    assert t.noise_of(3) == noise[3] and t.noise_of(100) is None and se.TargetSelector(table(noise), pairs).correlation_between(0, 1) == 0.95
    plan = t.plan(4, min_sep=20, min_noise=0.5).collect()
    assert plan and all(r.target in r.cols and all(noise[c] >= 0.5 or c == r.target for c in r.cols) for r in plan)
    with pytest.raises(ValueError):
        t.select(min_sep=5, max_sep=2)
    targets = spark.createDataFrame([(2,), (98,)], "target int")
    got = {r.target: r.cols for r in se.context_window(targets, table(noise), 3, 0.5).collect()}
    assert got == {c: [i for i in range(max(0, c - 3), min(100, c + 4)) if noise[i] >= 0.5 or i == c] for c in (2, 98)}
    assert t.context_window(98, 3, 0.5).first().cols == got[98]


@pytest.mark.parametrize("levels, min_sep, max_sep", [(1000, 3, 10), (3, 3, 10), (1, 0, 7), (4, 0, 3)])
def test_gaps_are_filled_one_best_channel_after_another(spark, levels, min_sep, max_sep):
    rng = np.random.default_rng(levels)
    noise = rng.integers(0, levels, 120) / 10
    ends = [2, 5, 60, 61, 119]

    def inside(low, high):
        """One gap at a time, by the definition."""
        step = max(min_sep, 1)
        fits = [c for c in range(low + step, high - step + 1) if noise[c] >= 0.1 or levels == 1]
        if high - low <= max_sep or not fits:
            return []
        best = min(fits, key=lambda c: (-noise[c], abs(c - (low + high) // 2), c))
        return [*inside(low, best), best, *inside(best, high)]

    want = sorted(ends + [c for low, high in zip(ends, ends[1:]) for c in inside(low, high)])
    table = spark.createDataFrame([(i, float(v)) for i, v in enumerate(noise)], "channel int, noise double")
    chosen = spark.createDataFrame([(c,) for c in ends], "channel int")
    assert sorted(r.channel for r in se.filled(chosen, table, max_sep, min_sep, 0.0 if levels == 1 else 0.1).collect()) == want


def test_augmentations(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((64, 8))
    df = image(spark, x)
    ops = {
        "noise": lambda d, s: au.add_noise(d, 0.1, s), "drop": lambda d, s: au.channel_dropout(d, 0.5, s), "mask": lambda d, s: au.time_mask(d, 10, s),
        "gain": lambda d, s: au.gain_randomization(d, seed=s), "mixup": lambda d, s: au.mixup(d, seed=s), "shuffle": lambda d, s: au.channel_shuffle(d, 5, s),
        "bands": lambda d, s: au.spectral_mask(d, 64.0, seed=s), "shift": lambda d, s: au.frequency_shift(d, 64.0, 8.0, s), "phase": lambda d, s: au.phase_shift(d, s),
        "warp": lambda d, s: au.spectral_warp(d, 64.0, seed=s), "time": lambda d, s: au.time_warp(d, 64.0, seed=s), "jitter": lambda d, s: au.frequency_jitter(d, 64.0, seed=s),
    }
    out = {}
    for name, op in ops.items():
        a, b, c = matrix(op(df, 1)), matrix(op(df.repartition(3), 1)), matrix(op(df, 2))
        assert a.shape == x.shape and np.allclose(a, b) and not np.isnan(a).any() and not np.allclose(a, x), name
        assert not np.allclose(a, c), name
        out[name] = a
    assert ((out["drop"] == 0).all(0) | (out["drop"] == x).all(0)).all()
    assert sorted(map(tuple, out["shuffle"].T)) == sorted(map(tuple, x.T))
    power = np.abs(np.fft.rfft(x, axis=0))
    assert np.allclose(np.abs(np.fft.rfft(out["phase"], axis=0)), power)
    gain = out["gain"] / x
    assert np.allclose(gain, gain[0]) and gain.min() >= 0.8 and gain.max() <= 1.2
    assert (matrix(au.time_mask(df, 100, 0)) == 0).all() and np.allclose(matrix(au.random_augment(df, 64.0, 0.0, 1)), x)
    assert not np.allclose(matrix(au.random_augment(df, 64.0, 1e-9, 1)), x) and np.allclose(matrix(au.mixup(df, 0.0, 1)), x)


def test_density_clusters(spark):
    rng = np.random.default_rng(12)
    blobs = np.concatenate([rng.normal(c, 0.1, (40, 2)) for c in ((0, 0), (3, 0), (0, 4))])
    labels = ml.density_clusters(np.concatenate([blobs, [[9.0, 9.0], [-9.0, 5.0]]]))
    assert (labels[120:] == -1).all()
    for i in range(3):
        own = labels[40 * i : 40 * i + 40]
        assert (own == i).sum() > 30 and set(own.tolist()) <= {i, -1}
    # single linkage by mutual reachability, against all paths
    x = rng.random((25, 2))
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, 4]
    reach = np.maximum(np.maximum(d, core), core[:, None])
    for k in range(25):
        reach = np.minimum(reach, np.maximum(reach[:, k : k + 1], reach[k : k + 1]))  # least largest step of a path
    tops, sets = {i: [i] for i in range(25)}, []
    for k, (a, b, distance, size) in enumerate(ml.density_tree(x, 5)):
        left, right = tops[int(a)], tops[int(b)]
        assert np.allclose(reach[np.ix_(left, right)], distance) and size == len(left) + len(right)
        tops[25 + k] = left + right
        sets.append(size)
    assert sets[-1] == 25
    assert ml.density_clusters(np.zeros((3, 2))).tolist() == [-1] * 3 and ml.density_clusters(np.zeros((0, 2))).tolist() == []
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(blobs)], "id int, features array<double>").repartition(3)
    found = ml.hdbscan(df, "id")
    assert {r.id: r.cluster for r in found.collect()} == dict(enumerate(ml.density_clusters(blobs).tolist()))
    assert ml.silhouette_of_centres(found.filter("cluster >= 0")) > 0.9


def test_kmeans_is_a_fixed_point(spark):
    rng = np.random.default_rng(14)
    x = np.concatenate([rng.normal(c, 1.0, (60, 3)) for c in (0, 4)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, features array<double>")
    own = np.array([r.cluster for r in ml.kmeans(df, 2).orderBy("id").collect()])
    centres = np.stack([x[own == c].mean(axis=0) for c in (0, 1)])
    assert (np.argmin(((x[:, None] - centres) ** 2).sum(axis=2), axis=1) == own).all()


def test_describe_and_missing_channels(spark):
    x = np.random.default_rng(13).random((50, 4))
    row = st.describe(image(spark, x).withColumn("value", F.when(F.col("t") > 0, F.col("value"))), "value").first()
    v = x[1:].ravel()
    assert row["count"] == len(v) and np.allclose([row.mean, row.std, row.min, row.p25, row.p50, row.p75, row.max], [v.mean(), v.std(ddof=1), v.min(), *np.quantile(v, [0.25, 0.5, 0.75]), v.max()])
    gap = image(spark, x).filter("channel <> 1 or t >= 25")
    got = {r.lag: r.rho for r in ch.neighbor_correlation(gap, 2).collect()}
    z = {c: (x[25 * (c == 1) :, c] - x[25 * (c == 1) :, c].mean()) / x[25 * (c == 1) :, c].std() for c in range(4)}
    pairs = {lag: np.concatenate([z[c][-min(len(z[c]), len(z[c + lag])) :] * z[c + lag][-min(len(z[c]), len(z[c + lag])) :] for c in range(4 - lag)]) for lag in (1, 2)}
    assert all(abs(got[lag] - pairs[lag].mean()) < 1e-9 for lag in (1, 2))
    with pytest.raises(Exception, match="dense image"):
        ch.correlation_matrix(gap).collect()


def test_quantiles_of_large_groups(spark):
    from fiberlake.operators import quantiles as qt

    rng = np.random.default_rng(3)
    rows = [(g, v) for g, x in enumerate([rng.standard_normal(3000), np.exp(rng.normal(0, 8, 2000)), np.repeat([1.0, 2.0], 500), np.array([5.0])]) for v in x.tolist()]
    df = spark.createDataFrame(rows + [(9, None)], "g int, value double").repartition(3)
    probs = [0.0, 0.01, 0.5, 0.999, 1.0]
    got = {r.g: r.q for r in qt.refine(df, ["g"], probs).collect()}
    want = {r.g: r.q for r in qt.percentiles(df.filter("value is not null"), ["g"], probs).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[g], want[g], rtol=1e-12) for g in want)
