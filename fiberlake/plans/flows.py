"""The end-to-end flows: cable offset, detection against ground truth, and a benchmark of all detectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import bandpass_kernel, morlet_power, on_rows
from ..operators import ais as ai
from ..operators import annotate as an
from ..operators import detect as de
from ..operators import evaluate as ev
from ..operators import image as im
from ..operators import offset as of
from ..operators import radon as ra
from ..operators import spectral as sp
from ..operators import stats as st


def kernel_labels(bands: list[tuple[float, float]], freqs: list[float]) -> list[str]:
    return [f"band {a:g}-{b:g} Hz" for a, b in bands] + [f"wavelet {f:g} Hz" for f in freqs]


def energy_images(waveform: DataFrame, fs: float, bands: list[tuple[float, float]], freqs: list[float]) -> DataFrame:
    """(label, file, file_ts, channel, value): an RMS image for each band and a wavelet image for each frequency, from a
    single pass over the samples."""
    kernels = [bandpass_kernel(fs, *b) for b in bands]
    labels = kernel_labels(bands, freqs)

    def measure(x):
        import numpy as np

        found = [np.sqrt((k(x) ** 2).mean(axis=1, keepdims=True)) for k in kernels]
        return np.concatenate([*found, morlet_power(x, fs, freqs)] if freqs else found, axis=1)

    rows = waveform.withColumn("m", on_rows(measure, F.col("samples"))).select("file", "file_ts", "channel", F.posexplode("m").alias("i", "value"))
    return rows.withColumn("label", F.element_at(F.array(*map(F.lit, labels)), F.col("i") + 1)).drop("i")


def cable_offset(waveform: DataFrame, positions: DataFrame, ais: DataFrame, fs: float, spacing_m: float, bands: list[tuple[float, float]], freqs: list[float], margins_m: list[float], expected: tuple[float, float] = (1200.0, 1500.0)) -> tuple[DataFrame, DataFrame]:
    """(winner, sweeps): the offset of the sweep with the flattest plateau, and all sweeps."""
    near = ai.transiting(ai.near_route(ais, positions, "ord"))
    candidates = ai.closest_reports(near, "ord").select(F.col("MMSI").alias("cand_id"), "Latitude", "Longitude", "Timestamp")
    sweeps = []
    for band, freq in [([b], []) for b in bands] + [([], [f]) for f in freqs]:
        image = energy_images(waveform, fs, band, freq).withColumnsRenamed({"file_ts": "bin_time"}).withColumn("t", F.unix_micros(F.col("bin_time").cast("timestamp")))
        sweeps.append(of.margin_sensitivity(candidates, image.drop("label"), positions, spacing_m, margins_m).withColumn("label", F.lit(kernel_labels(band, freq)[0])))
    sweeps = reduce(DataFrame.unionByName, sweeps)
    return of.offset_winner(sweeps, margins_m[-2:], expected), sweeps


def detect_and_evaluate(train: DataFrame, test: DataFrame, positions: DataFrame, ais: DataFrame, fs: float, step: int, spacing_m: float, ranges_m: list[float], max_time_s: float = 300.0) -> DataFrame:
    """Metrics by range of the clustered z-score detections of `test`, against the crossings of transiting ships."""
    base = st.channel_baseline(im.build_image(train, "rms", fs, (1.0, 20.0)).select("channel", "value", F.lit(0).alias("t")))
    kept = post_processed(de.detect_stream(test, base, fs, step), step)
    events = de.cluster_detections(kept, 10.0, max(1, round(500 / spacing_m))).withColumn("det_id", F.monotonically_increasing_id())
    near = ai.transiting(ai.near_route(ais, positions, "ord"))
    truth = ev.ground_truth_crossings(near, positions, "ord").withColumn("gt_id", F.col("MMSI"))
    return ev.evaluate_at_ranges(events, truth, positions, ranges_m, max_time_s)


def post_processed(detections: DataFrame, step: int) -> DataFrame:
    """Without fibre-wide and without lonely triggers."""
    return de.spatial_corroboration(de.common_mode_suppression(detections), step, 5.0)


def dense_baseline(waveform: DataFrame, fs: float, z: float = 4.0) -> DataFrame:
    """Detections of a fixed threshold on the z-scores of an RMS image."""
    image = im.build_image(waveform, "rms", fs, (1.0, 20.0)).withColumnRenamed("file_ts", "timestamp")
    return de.fixed_threshold(image, z).select("file", "timestamp", F.lit(0.0).alias("time_s"), "channel", "score", "triggered")


def benchmark_all(waveform: DataFrame, positions: DataFrame, ais: DataFrame, fs: float, step: int, radius: int, slownesses: list[float], ranges_m: list[float], wavelets: list[float] = (5.0, 20.0, 80.0)) -> DataFrame:
    """Scores by method and range against annotations of all files; all methods but the fixed threshold are
    post-processed."""
    files = waveform.select("file", "file_ts").distinct()
    annotations = an.annotate_files(files, ai.near_route(ais, positions, "ord"), positions, "ord")
    base = st.channel_baseline(im.build_image(waveform, "rms", fs, (1.0, 20.0)).select("channel", "value", F.lit(0).alias("t")))
    methods = {"fixed threshold": dense_baseline(waveform, fs), "temporal z": post_processed(de.detect_stream(waveform, base, fs, step), step)}
    methods["STA/LTA band"] = post_processed(de.sta_lta_stream(waveform, fs, step, sustain=0.3), step)
    for f in wavelets:
        if f < fs / 2:
            methods[f"STA/LTA wavelet {f:g} Hz"] = post_processed(de.sta_lta_stream(waveform, fs, step, None, f, sustain=0.3), step)
    methods["Radon"] = post_processed(ra.radon_detect_stream(waveform, fs, step, radius, slownesses, 0.1), step)
    every = reduce(DataFrame.unionByName, [d.select("file", "channel", "triggered", F.lit(m).alias("method")) for m, d in methods.items()])
    return an.benchmark_detections(every, annotations, ranges_m, ("method",))


def ship_psd_features(waveform: DataFrame, annotations: DataFrame, fs: float, edges: list[float], ship_m: float = 300.0, noise_m: float = 2000.0, noise_channels: int = 3, seed: int = 0) -> DataFrame:
    """(file, channel, distance_m, label, dominant_freq_hz, total_power, bands): spectra of the nearest channel of files
    with a ship within ship_m, and of a few channels, chosen by a keyed hash, of files without one within noise_m."""
    from pyspark.sql import Window

    files = annotations.groupBy("file").agg(F.min("distance_m").alias("near"), F.min(F.struct("distance_m", "channel"))["channel"].alias("ship"))
    rows = annotations.join(files, "file")
    drawn = F.row_number().over(Window.partitionBy("file").orderBy(F.xxhash64(F.lit(seed), "file", "channel")))
    quiet = rows.filter(F.col("near") >= noise_m).withColumn("n", drawn).filter(F.col("n") <= noise_channels).withColumn("label", F.lit("noise"))
    loud = rows.filter((F.col("near") <= ship_m) & (F.col("channel") == F.col("ship"))).withColumn("label", F.lit("ship"))
    chosen = loud.select("file", "channel", "distance_m", "label").unionByName(quiet.select("file", "channel", "distance_m", "label"))
    picked = waveform.join(F.broadcast(chosen), ["file", "channel"]).withColumn("key", F.concat_ws("|", "file", "channel"))
    spectra = picked.select("key", F.explode(sp.channel_psd(F.col("samples"), fs, 2048)).alias("x")).select("key", "x.freq", "x.power")
    return picked.select("key", "file", "channel", "distance_m", "label").join(sp.psd_features(spectra, "key", edges), "key").drop("key")


