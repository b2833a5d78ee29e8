import numpy as np
import pytest
from pyspark.sql import functions as F

from fiberlake.functions import kernels as k
from fiberlake.operators import spectral as sp

FS = 400.0


def tone(freq, n=4000, amplitude=1.0):
    return amplitude * np.sin(2 * np.pi * freq * np.arange(n) / FS)


def response(sos, freqs):
    z = np.exp(-2j * np.pi * np.asarray(freqs) / FS)
    return np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, _, a1, a2 in sos], axis=0)


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5])
def test_butterworth_magnitude(order):
    """The squared magnitude is 1 / (1 + x ** (2 order)) in the prewarped frequency."""
    warp = lambda f: np.tan(np.pi * np.asarray(f, float) / FS)
    f = np.array([0.5, 1, 3, 5, 12, 20, 40, 120])
    for kind, band in (("lowpass", 20.0), ("highpass", 20.0), ("bandpass", (1.0, 20.0)), ("bandstop", (1.0, 20.0))):
        sos = k.butterworth(order, band, kind, FS)
        w = warp(f)
        if kind == "lowpass":
            x = w / warp(20)
        elif kind == "highpass":
            x = warp(20) / w
        else:
            x = (w**2 - warp(1) * warp(20)) / (w * (warp(20) - warp(1)))
            x = x if kind == "bandpass" else 1 / np.where(x == 0, 1e-300, x)
        assert np.allclose(np.abs(response(sos, f)) ** 2, 1 / (1 + x ** (2.0 * order)), atol=1e-9)
        poles = np.concatenate([np.roots(s[3:]) for s in sos])
        assert np.abs(poles).max() < 1
    for bad in ((0.0, 20.0), (1.0, 200.0)):
        with pytest.raises(ValueError):
            k.butterworth(order, bad, "bandpass", FS)


def test_filtfilt_gain_and_phase():
    sos = k.butterworth(4, (1.0, 20.0), "bandpass", FS)
    for f in (0.3, 5.0, 19.0, 60.0):
        y = k.filtfilt(sos, tone(f)[None, :])[0][1000:3000]
        want = np.abs(response(sos, [f])[0]) ** 2 * tone(f)[1000:3000]
        assert np.abs(y - want).max() < 0.02
    x = np.random.default_rng(0).standard_normal((3, 500))
    low = k.butterworth(4, 20.0, "lowpass", FS)
    assert np.allclose(k.filtfilt(low, np.full((2, 300), 7.0)), 7.0)
    with pytest.raises(ValueError):
        k.filtfilt(sos, x[:, :20])


def test_blocks_filter_as_single_samples_do():
    rng = np.random.default_rng(3)
    for band, kind in (((1.0, 20.0), "bandpass"), (0.5, "lowpass"), ((49.0, 51.0), "bandstop")):
        sos, x, states = k.butterworth(4, band, kind, FS), rng.standard_normal((5, 1000)), rng.standard_normal((5, 8))[:, : 2 * len(k.butterworth(4, band, kind, FS))]
        want = k._sample_by_sample(sos, x, states)[0]
        got = k.sos_filter(sos, x, states.T.reshape(len(sos), 2, 5))
        assert np.allclose(got, want, atol=1e-8 * np.abs(want).max())


def test_steady_state():
    sos = k.butterworth(3, 30.0, "lowpass", FS)
    y = k.sos_filter(sos, np.ones((1, 50)), k.steady_state(sos)[:, :, None] * np.ones(1))
    assert np.allclose(y, 1.0)


def test_welch():
    x = np.stack([tone(30), tone(30, amplitude=3)])
    freqs, psd = k.welch(x, FS, 1024)
    assert abs(freqs[psd[0].argmax()] - 30) < 1 and np.allclose(psd[1], 9 * psd[0])
    noise = np.random.default_rng(1).standard_normal((1, 200_000))
    f, p = k.welch(noise, FS, 512)
    assert abs(p[0, 1:-1].mean() * FS / 2 - 1) < 0.02


def test_morlet():
    x = np.stack([tone(20), tone(20, amplitude=10)])
    power = k.morlet_power(x, FS, [5.0, 20.0, 80.0])
    assert power[0].argmax() == 1 and abs(power[1, 1] / power[0, 1] - 100) < 1e-6
    series = k.morlet_series(x, FS, 20.0)
    assert np.allclose(series.mean(axis=1), power[:, 1])


def test_on_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, 2.0, 3.0]), (4, [5.0, 6.0])]
    df = spark.createDataFrame(rows, "id int, x array<double>").select("id", k.on_rows(lambda v: v * v.shape[1], F.col("x")).alias("y"))
    assert {r.id: r.y for r in df.collect()} == {1: [2.0, 4.0], 2: None, 3: [3.0, 6.0, 9.0], 4: [10.0, 12.0]}


def test_filters_on_columns(spark):
    df = spark.createDataFrame([(1, (tone(5) + tone(60)).tolist())], "id int, x array<double>")
    x = F.col("x")
    row = df.select(sp.bandpass(x, FS, 1, 20).alias("b"), sp.bandstop(x, FS, 1, 20).alias("s"), sp.lowpass(x, FS, 20).alias("l"), sp.highpass(x, FS, 20).alias("h"), sp.notch(x, FS, 60.0, 10).alias("n")).first()
    inside = slice(1000, 3000)
    for name, want in (("b", tone(5)), ("l", tone(5)), ("s", tone(60)), ("h", tone(60)), ("n", tone(5))):
        assert np.abs(np.array(row[name])[inside] - want[inside]).max() < 0.05, name


def test_band_powers_and_dominant(spark):
    psd = spark.createDataFrame([(1, float(f), float(f % 7)) for f in range(40)], "id int, freq double, power double")
    assert sp.dominant_frequency(psd, "id", 5, 30).first().freq == 6.0
    with pytest.raises(Exception, match="no frequency within"):
        sp.dominant_frequency(psd, "id", 100).collect()
    bands = {r.band: r.power for r in sp.band_powers(psd, "id", [0, 10, 20, 100, 200]).collect()}
    assert bands == {0: sum(f % 7 for f in range(10)), 1: sum(f % 7 for f in range(10, 20)), 2: sum(f % 7 for f in range(20, 40)), 3: 0.0}
