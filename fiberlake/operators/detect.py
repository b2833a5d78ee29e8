"""Detectors on images and waveforms, and filters on their detections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ARRAY_REDUCERS
from ..functions.kernels import bandpass_kernel, filtfilt, butterworth, morlet_series, on_rows, trim_samples
from ..schema import DEFAULT_BANDPASS_HZ, EDGE_TRIM_S, EVENTS


def step_channels(image: DataFrame, step: int) -> DataFrame:
    """(channel): every step-th channel and the last one."""
    if step < 1:
        raise ValueError("step must be 1 at least")
    last = F.broadcast(image.agg(F.max("channel").alias("__last")))
    channels = image.select("channel").distinct()
    return channels.crossJoin(last).filter((F.col("channel") % step == 0) | (F.col("channel") == F.col("__last"))).select("channel")


def fixed_threshold(image: DataFrame, z: float = 4.0) -> DataFrame:
    """image with score, the z-score within the channel, and triggered (score over z)."""
    from .channels import zscore

    scored = zscore(image, "channel").withColumnRenamed("value", "score")
    return scored.withColumn("triggered", F.col("score") > z)


def _sub_windows(samples: Column, parts: int) -> Column:
    """RMS of `parts` equal parts; samples after the last whole part are left out."""
    size = F.floor(F.size(samples) / parts).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda w: ARRAY_REDUCERS["rms"](F.slice(samples, w * size + 1, size)))


def detect_stream(waveform: DataFrame, baseline: DataFrame, fs: float, step: int, z_threshold: float = 6.0, sustain: float = 0.9, band: tuple[float, float] = DEFAULT_BANDPASS_HZ, sub_windows: int = 10) -> DataFrame:
    """(time_s, channel, score, triggered, timestamp, file): a row for each sub-window and stepped channel of a file.

    score is the RMS of the filtered and trimmed sub-window against the channel's floor and scale. A channel triggers in
    a file, in all its sub-windows alike, if its score is over z_threshold in a share `sustain` of them. Only stepped
    channels are filtered. All of it happens in a file's own rows; the baseline is joined by channel.
    """
    kernel = bandpass_kernel(fs, *band)
    stepped = waveform.join(F.broadcast(step_channels(waveform, step)), "channel")
    rows = stepped.withColumn("__n", F.size("samples")).withColumn("samples", on_rows(lambda x: _trimmed(kernel(x), fs), F.col("samples")))
    trim = ((F.col("__n") - F.size("samples")) / 2).cast("int")
    size = F.floor(F.size("samples") / sub_windows)
    scored = rows.join(F.broadcast(baseline), "channel").select(
        "file", "file_ts", "channel", (trim / fs).alias("__begin"), (size / fs).alias("__size"),
        F.transform(_sub_windows(F.col("samples"), sub_windows), lambda e: (e - F.col("floor")) / F.col("scale")).alias("__z"),
    )
    over = F.size(F.filter("__z", lambda z: z > z_threshold)) / F.size("__z")
    each = scored.withColumn("triggered", over >= sustain).select("file", "file_ts", "channel", "triggered", "__begin", "__size", F.posexplode("__z").alias("__w", "score"))
    time = (F.col("__w") + 0.5) * F.col("__size") + F.col("__begin")
    stamp = F.col("file_ts") + F.make_dt_interval(secs=time.cast("decimal(18,6)"))
    return each.withColumn("time_s", time).withColumn("timestamp", stamp).select("time_s", "channel", "score", "triggered", "timestamp", "file")


def _trimmed(x: np.ndarray, fs: float) -> np.ndarray:
    trim = trim_samples(x.shape[1], fs, EDGE_TRIM_S)
    return x[:, trim : x.shape[1] - trim]


def bandpass_trimmed(waveform: DataFrame, fs: float, band: tuple[float, float] = DEFAULT_BANDPASS_HZ) -> DataFrame:
    """waveform filtered and without its edges, where the filter settles."""
    kernel = bandpass_kernel(fs, *band)
    return waveform.withColumn("samples", on_rows(lambda x: _trimmed(kernel(x), fs), F.col("samples")))


def detect_image(image: DataFrame, baseline: DataFrame, bins_a_file: int, z_threshold: float, sustain: float) -> DataFrame:
    """(file, t, channel, score, triggered) for an image whose files are blocks of time bins: the same decision with one
    bin as a sub-window."""
    scored = image.join(F.broadcast(baseline), "channel").select(F.floor(F.col("t") / bins_a_file).alias("file"), "t", "channel", ((F.col("value") - F.col("floor")) / F.col("scale")).alias("score"))
    share = F.avg((F.col("score") > z_threshold).cast("double")).over(Window.partitionBy("file", "channel"))
    return scored.withColumn("triggered", share >= sustain)


def common_mode_suppression(detections: DataFrame, max_frac: float = 0.05, by: tuple[str, ...] = ("file", "time_s")) -> DataFrame:
    """Triggers of a time at which over max_frac of the channels trigger are taken back.

    The share comes from an aggregate that combines before it shuffles, so a file of many channels is no large group.
    """
    share = detections.groupBy(*by).agg(F.avg(F.col("triggered").cast("double")).alias("__share"))
    return detections.join(share, [*by]).withColumn("triggered", F.col("triggered") & (F.col("__share") <= max_frac)).drop("__share")


def spatial_corroboration(detections: DataFrame, channel_gap: int, time_tol_s: float = 5.0, time: str = "timestamp") -> DataFrame:
    """Triggers without another trigger of the file within channel_gap and time_tol_s, both included, are taken back.
    The other may be of the same channel at another time.

    Triggers meet by file and by cells of channel_gap channels, each with its neighbours, so a file's triggers are not
    all compared.
    """
    rows = detections.withColumn("__row", F.monotonically_increasing_id())
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6 if dict(detections.dtypes)[time].startswith("timestamp") else F.col(time).cast("double")
    gap = max(1, channel_gap)
    cell = F.floor(F.col("channel") / gap)
    own = rows.filter("triggered").select("__row", "file", F.col("channel").alias("__c"), seconds.alias("__t"), cell.alias("__cell"))
    other = own.select(F.col("__row").alias("__o"), "file", F.col("__c").alias("__oc"), F.col("__t").alias("__ot"), F.explode(F.array(F.col("__cell") - 1, F.col("__cell"), F.col("__cell") + 1)).alias("__cell"))
    near = (F.abs(F.col("__c") - F.col("__oc")) <= channel_gap) & (F.abs(F.col("__t") - F.col("__ot")) <= time_tol_s) & (F.col("__row") != F.col("__o"))
    other = other.withColumnsRenamed({"file": "__file", "__cell": "__near"})
    kept = own.join(other, (F.col("file") == F.col("__file")) & (F.col("__cell") == F.col("__near")) & near, "left_semi").select("__row", F.lit(True).alias("__kept"))
    return rows.join(kept, "__row", "left").withColumn("triggered", F.col("triggered") & F.coalesce("__kept", F.lit(False))).drop("__row", "__kept")


def cluster_detections(detections: DataFrame, time_tol_s: float = 5.0, channel_tol: int = 50) -> DataFrame:
    """(timestamp, channel, score, n_members): triggers gathered around the strongest one left, again and again.

    Members are within both tolerances of the seed, so no cluster crosses a silence of more than time_tol_s: triggers are
    split at silences, first within an hour's rows and then across the hours, and each island is gathered by itself.
    Equal scores go by timestamp and channel.
    """
    rows = detections.filter("triggered").select("timestamp", "channel", "score", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us"))
    tolerance = int(time_tol_s * 1e6)
    # cells of two tolerances: an island boundary is a silence between neighbouring triggers
    hour = rows.withColumn("hour", F.floor(F.col("us") / 3_600_000_000))
    inside = Window.partitionBy("hour").orderBy("us")
    first = F.coalesce(F.col("us") - F.lag("us").over(inside) > tolerance, F.lit(True))
    parts = hour.withColumn("part", F.sum(first.cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # a part that begins an hour may go on from the last part of an earlier one; a row an hour and part is little
    spans = parts.groupBy("hour", "part").agg(F.min("us").alias("begin"), F.max("us").alias("end"))
    along = Window.orderBy("begin")
    joined = F.coalesce(F.col("begin") - F.lag("end").over(along) > tolerance, F.lit(True))
    islands = spans.withColumn("island", F.sum(joined.cast("long")).over(along)).select("hour", "part", "island")

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["us", "channel"], ignore_index=True)
        us, channel = pdf["us"].to_numpy(), pdf["channel"].to_numpy()
        first, last = np.searchsorted(us, us - tolerance), np.searchsorted(us, us + tolerance, side="right")
        left, seeds, members = np.ones(len(pdf), bool), [], []
        for i in np.argsort(-pdf["score"].to_numpy(), kind="stable"):
            if left[i]:
                near = slice(first[i], last[i])  # an island's length does not matter
                own = left[near] & (np.abs(channel[near] - channel[i]) <= channel_tol)
                left[near] &= ~own
                seeds.append(i)
                members.append(int(own.sum()))
        return pdf.loc[seeds, ["timestamp", "channel", "score"]].assign(n_members=members)

    return parts.join(islands, ["hour", "part"]).groupBy("island").applyInPandas(lambda pdf: gather(pdf), EVENTS.replace("timestamp_ntz", dict(detections.dtypes)["timestamp"]))


def sta_lta_ratio(bins: DataFrame, short: int, long: int, order: tuple[str, ...] = ("t",)) -> DataFrame:
    """bins (channel, order, value) with ratio: the mean of the last `short` bins over that of the `long` bins before.

    Both means take what there is; the ratio is null while no bin precedes the short mean. The order runs on from file
    to file.
    """
    w = Window.partitionBy("channel").orderBy(*order)
    before = w.rowsBetween(-(short + long - 1), -short)
    ratio = F.avg("value").over(w.rowsBetween(-(short - 1), 0)) / F.greatest(F.avg("value").over(before), F.lit(1e-12))
    return bins.withColumn("ratio", F.when(F.count("value").over(before) > 0, ratio))


def sta_lta_files(ratios: DataFrame, threshold: float, sustain: float, by: tuple[str, ...] = ("file", "channel")) -> DataFrame:
    """(by, score, triggered): the largest ratio of a file and channel; it triggers if a share `sustain` of the bins is
    over the threshold, bins without a ratio counting as not."""
    over = F.avg(F.coalesce(F.col("ratio") > threshold, F.lit(False)).cast("double"))
    return ratios.groupBy(*by).agg(F.max("ratio").alias("score"), (over >= sustain).alias("triggered"))


def energy_bins(waveform: DataFrame, fs: float, bin_s: float, band: tuple[float, float] | None, wavelet_freq: float | None) -> DataFrame:
    """(file, file_ts, channel, bin, n_bins, value): mean energy of each bin; an incomplete last bin is dropped."""
    if (band is None) == (wavelet_freq is None):
        raise ValueError("give either a band or a wavelet frequency")
    if band is not None:
        sos = butterworth(4, band, "bandpass", fs)
        energy = lambda x: filtfilt(sos, x) ** 2
    else:
        energy = lambda x: morlet_series(x, fs, wavelet_freq)
    size = max(1, round(bin_s * fs))

    def binned(x: np.ndarray) -> np.ndarray:
        n = x.shape[1] // size
        return energy(x)[:, : n * size].reshape(len(x), n, size).mean(axis=2)

    rows = waveform.withColumn("samples", on_rows(binned, F.col("samples")))
    return rows.select("file", "file_ts", "channel", F.size("samples").alias("n_bins"), F.posexplode("samples").alias("bin", "value"))


def sta_lta_stream(waveform: DataFrame, fs: float, step: int, band: tuple[float, float] | None = DEFAULT_BANDPASS_HZ, wavelet_freq: float | None = None, bin_s: float = 0.25, short_s: float = 1.0, long_s: float = 20.0, threshold: float = 3.0, sustain: float = 0.5) -> DataFrame:
    """(file, timestamp, time_s, channel, score, triggered): STA/LTA of all files in the order of their times, a row for
    each file and stepped channel. Bins at a band-passed file's edges feed the averages but not the decision."""
    stepped = waveform.join(F.broadcast(step_channels(waveform, step)), "channel")
    bins = energy_bins(stepped, fs, bin_s, band, wavelet_freq)
    ratios = sta_lta_ratio(bins, max(1, round(short_s / bin_s)), max(1, round(long_s / bin_s)), ("file_ts", "bin"))
    edge = round(EDGE_TRIM_S / bin_s) if band is not None else 0
    inside = (F.col("n_bins") <= 2 * edge) | (F.col("bin").between(F.lit(edge), F.col("n_bins") - edge - 1))
    found = sta_lta_files(ratios.filter(inside), threshold, sustain, ("file", "file_ts", "channel"))
    return found.select("file", F.col("file_ts").alias("timestamp"), F.lit(0.0).alias("time_s"), "channel", "score", "triggered")

