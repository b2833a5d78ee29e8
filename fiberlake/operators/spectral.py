"""Filters, spectra and wavelet power of rows of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
import numpy as np
import pyarrow as pa

from ..functions.kernels import butterworth, filtfilt, morlet_power, morlet_series, on_rows, welch
from ..schema import MORLET_W0


def _filter(samples: Column, fs: float, band, kind: str, order: int) -> Column:
    sos = butterworth(order, band, kind, fs)
    return on_rows(lambda x: filtfilt(sos, x), samples)


def bandpass(samples: Column, fs: float, low: float, high: float, order: int = 4) -> Column:
    return _filter(samples, fs, (low, high), "bandpass", order)


def bandstop(samples: Column, fs: float, low: float, high: float, order: int = 4) -> Column:
    return _filter(samples, fs, (low, high), "bandstop", order)


def lowpass(samples: Column, fs: float, cutoff: float, order: int = 4) -> Column:
    return _filter(samples, fs, cutoff, "lowpass", order)


def highpass(samples: Column, fs: float, cutoff: float, order: int = 4) -> Column:
    return _filter(samples, fs, cutoff, "highpass", order)


def notch(samples: Column, fs: float, freq: float, quality: float = 30.0) -> Column:
    """A band-stop of order 4, freq / quality wide."""
    half = freq / (2 * quality)
    return bandstop(samples, fs, max(freq - half, 1e-4), freq + half)


def channel_psd(samples: Column, fs: float, nperseg: int = 1024) -> Column:
    """Welch's density, as an array of (freq, power)."""
    kind = T.ArrayType(T.StructType([T.StructField("freq", T.DoubleType()), T.StructField("power", T.DoubleType())]))

    @F.arrow_udf(kind)
    def run(column: pa.Array) -> pa.Array:
        out = []
        for v in column.to_pylist():
            if v is None:
                out.append(None)
                continue
            freqs, psd = welch(np.asarray(v, float)[None, :], fs, nperseg)
            out.append([{"freq": f, "power": p} for f, p in zip(freqs.tolist(), psd[0].tolist(), strict=True)])
        return pa.array(out, pa.list_(pa.struct([("freq", pa.float64()), ("power", pa.float64())])))

    return run(samples)


def dft_power(rows: DataFrame, by: str, samples: str = "samples") -> DataFrame:
    """(by, k, power): |X_k|^2 of each row for k = 0 .. n / 2, by array expressions alone. For short rows; an FFT kernel
    serves long ones."""
    n = F.size(samples)

    def part(wave) -> Column:
        return F.aggregate(F.transform(F.col(samples), lambda x, i: x * wave(F.lit(2.0) * F.pi() * F.col("k") * i / n)), F.lit(0.0), lambda a, x: a + x)

    spread = rows.select(by, samples, F.explode(F.sequence(F.lit(0), F.floor(n / 2).cast("int"))).alias("k"))
    re, im = part(F.cos), part(F.sin)
    return spread.select(by, "k", (re * re + im * im).alias("power"))


def dominant_frequency(spectra: DataFrame, by: str, fmin: float = 0.0, fmax: float | None = None) -> DataFrame:
    """(by, freq): the strongest frequency within [fmin, fmax], the lowest of equals. spectra: (by, freq, power). A
    spectrum without frequencies there is an error."""
    inside = F.col("freq").between(fmin, float("inf") if fmax is None else fmax)
    best = F.max(F.when(inside, F.struct("power", (-F.col("freq")).alias("f"))))
    none = F.raise_error(F.lit(f"a spectrum has no frequency within [{fmin}, {fmax}]")).cast("double")
    return spectra.groupBy(by).agg(best.alias("best")).select(by, F.when(F.col("best").isNull(), none).otherwise(-F.col("best.f")).alias("freq"))


def band_powers(spectra: DataFrame, by: str, edges: list[float], normalized: bool = False) -> DataFrame:
    """(by, band, power): sums of the bins in [edges[b], edges[b + 1]), 0 for a band without bins; or their parts of all
    bands' sum."""
    sums = [F.sum(F.when((F.col("freq") >= a) & (F.col("freq") < b), F.col("power")).otherwise(0.0)) for a, b in zip(edges, edges[1:], strict=False)]
    bands = spectra.groupBy(by).agg(F.array(*sums).alias("bands"))
    rows = bands.select(by, "bands", F.posexplode("bands").alias("band", "power"))
    if normalized:
        total = F.aggregate("bands", F.lit(0.0), lambda a, x: a + x)
        rows = rows.withColumn("power", F.when(total == 0, 0.0).otherwise(F.try_divide(F.col("power"), total)))
    return rows.select(by, "band", "power")


def morlet_cwt_power(samples: Column, fs: float, freqs: list[float], w0: float = MORLET_W0) -> Column:
    """Mean wavelet power at each frequency, as an array."""
    return on_rows(lambda x: morlet_power(x, fs, freqs, w0), samples)


def morlet_cwt_power_series(samples: Column, fs: float, freq: float, w0: float = MORLET_W0) -> Column:
    return on_rows(lambda x: morlet_series(x, fs, freq, w0), samples)


def wavelet_image(waveform: DataFrame, fs: float, freq: float) -> DataFrame:
    """(file, file_ts, channel, value): mean wavelet power of each file and channel at single precision."""
    power = morlet_cwt_power(F.col("samples"), fs, [freq])[0]
    return waveform.select("file", "file_ts", "channel", power.cast("float").cast("double").alias("value"))


def psd_features(spectra: DataFrame, by: str, edges: list[float], fmin: float = 0.5) -> DataFrame:
    """(by, dominant_freq_hz, total_power, bands): features of each spectrum, bands as parts of their sum."""
    dominant = dominant_frequency(spectra, by, fmin).withColumnRenamed("freq", "dominant_freq_hz")
    total = spectra.groupBy(by).agg(F.sum("power").alias("total_power"))
    bands = band_powers(spectra, by, edges, normalized=True).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "power"))), lambda x: x["power"]).alias("bands"))
    return dominant.join(total, by).join(bands, by)


def psd_quartiles(spectra: DataFrame, *by: str) -> DataFrame:
    """(by, freq, p25, median, p75) over the spectra of each label."""
    q = F.percentile("power", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return spectra.groupBy(*by, "freq").agg(q.alias("q")).select(*by, "freq", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"))
