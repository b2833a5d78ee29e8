"""Signal kernels on numpy arrays of rows (rows, samples), and Spark functions that apply them to Arrow batches."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import MORLET_W0

Kernel = Callable[[np.ndarray], np.ndarray]


def butterworth(order: int, band: float | tuple[float, float], kind: str, fs: float) -> np.ndarray:
    """Second-order sections (b0 b1 b2 1 a1 a2) of a digital Butterworth filter.

    kind: lowpass, highpass, bandpass or bandstop. The analog prototype's poles lie on the unit circle; they are moved to
    the band, whose edges are prewarped, and mapped by the bilinear transform.
    """
    edges = np.atleast_1d(np.asarray(band, float))
    if np.any(edges <= 0) or np.any(edges >= fs / 2) or (len(edges) == 2) != (kind in ("bandpass", "bandstop")):
        raise ValueError(f"the band {band} must lie within 0 and {fs / 2} Hz and fit the kind {kind}")
    w = 2 * fs * np.tan(np.pi * edges / fs)
    unit = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if kind == "lowpass":
        poles, zeros, gain = unit * w[0], np.zeros(0, complex), w[0] ** order
    elif kind == "highpass":
        poles, zeros, gain = w[0] / unit, np.zeros(order, complex), 1.0
    else:
        width, middle = w[1] - w[0], w[0] * w[1]
        half = unit * width / 2 if kind == "bandpass" else width / 2 / unit
        root = np.sqrt(half * half - middle)
        poles = np.concatenate([half + root, half - root])
        zeros = np.zeros(order, complex) if kind == "bandpass" else 1j * np.sqrt(middle) * np.repeat([1, -1], order)
        gain = width**order if kind == "bandpass" else 1.0
    gain *= np.real(np.prod(2 * fs - zeros) / np.prod(2 * fs - poles))
    zeros = np.concatenate([(2 * fs + zeros) / (2 * fs - zeros), -np.ones(len(poles) - len(zeros))])
    poles = (2 * fs + poles) / (2 * fs - poles)

    def pairs(roots: np.ndarray) -> list[tuple[complex, complex | None]]:
        upper = [(r, np.conj(r)) for r in roots if r.imag > 1e-9]
        real = sorted(r.real for r in roots if abs(r.imag) <= 1e-9)
        # real roots from both ends, so that zeros at 1 and -1 share a section
        while len(real) > 1:
            upper.append((real.pop(0), real.pop()))
        return upper + [(r, None) for r in real]

    sections = []
    for (z1, z2), (p1, p2) in zip(pairs(zeros), sorted(pairs(poles), key=lambda p: abs(p[0])), strict=True):
        b = np.real([1, -z1, 0] if z2 is None else [1, -z1 - z2, z1 * z2])
        a = np.real([1, -p1, 0] if p2 is None else [1, -p1 - p2, p1 * p2])
        sections.append(np.concatenate([b, a]))
    sos = np.array(sections)
    sos[0, :3] *= gain
    return sos


def steady_state(sos: np.ndarray) -> np.ndarray:
    """States of the sections (transposed direct form II) after a unit step has settled."""
    states, level = [], 1.0
    for b0, b1, b2, _, a1, a2 in sos:
        out = (b0 + b1 + b2) / (1 + a1 + a2)
        states.append([(b1 + b2 - (a1 + a2) * out) * level, (b2 - a2 * out) * level])
        level *= out
    return np.array(states)


#: Samples that a filter takes at once.
BLOCK = 64


def _sample_by_sample(sos: np.ndarray, x: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(y, states after it) of rows x; states: (rows, 2 * sections)."""
    y, after = np.ascontiguousarray(x.T), states.copy()
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        s, z = after[:, 2 * k], after[:, 2 * k + 1]
        for n in range(len(y)):
            now = y[n]
            out = b0 * now + s
            s = b1 * now - a1 * out + z
            z = b2 * now - a2 * out
            y[n] = out
        after[:, 2 * k], after[:, 2 * k + 1] = s, z
    return y.T, after


@functools.lru_cache(64)
def _blocks(sos: bytes, sections: int) -> tuple[np.ndarray, ...]:
    """What a block's samples and the states before it add to its output and to the states after it."""
    coefficients = np.frombuffer(sos).reshape(sections, 6)
    none, units = np.zeros((BLOCK, 2 * sections)), np.eye(2 * sections)
    output, after = _sample_by_sample(coefficients, np.eye(BLOCK), none)
    return output, after, *_sample_by_sample(coefficients, np.zeros((2 * sections, BLOCK)), units)


def sos_filter(sos: np.ndarray, x: np.ndarray, states: np.ndarray) -> np.ndarray:
    """Causal filtering of the rows of x; states: (sections, 2, rows).

    The filter is linear, so a block of samples is two matrix products of all rows: Python loops over blocks alone.
    """
    sos = np.ascontiguousarray(sos, float)
    held = np.ascontiguousarray(np.broadcast_to(states, (*states.shape[:2], len(x))).reshape(-1, len(x)).T)
    whole = x.shape[1] // BLOCK * BLOCK
    out = np.empty(x.shape)
    if whole:
        of_samples, to_states, of_states, kept = _blocks(sos.tobytes(), len(sos))
        for at in range(0, whole, BLOCK):
            part = x[:, at : at + BLOCK]
            out[:, at : at + BLOCK] = part @ of_samples + held @ of_states
            held = part @ to_states + held @ kept
    out[:, whole:] = _sample_by_sample(sos, x[:, whole:], held)[0]
    return out


def filtfilt(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filtering forth and back, without phase. The rows are extended at both ends by their point reflection."""
    pad = 3 * (2 * len(sos) + 1 - min(int((sos[:, 2] == 0).sum()), int((sos[:, 5] == 0).sum())))
    if x.shape[1] <= pad:
        raise ValueError(f"{x.shape[1]} samples are too few; more than {pad} are needed")
    y = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], axis=1)
    settled = steady_state(sos)[:, :, None]
    for _ in range(2):
        y = sos_filter(sos, y, settled * y[:, 0])[:, ::-1]
    return y[:, pad:-pad]


def bandpass_kernel(fs: float, low: float, high: float, order: int = 4) -> Kernel:
    sos = butterworth(order, (low, high), "bandpass", fs)
    return lambda x: filtfilt(sos, x)


def trim_samples(n: int, fs: float, edge_s: float) -> int:
    """Samples to cut at each end of a filtered signal; none if too few would be left."""
    trim = round(edge_s * fs)
    return trim if n > 2 * trim else 0


def welch(x: np.ndarray, fs: float, nperseg: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(freqs, psd of each row): one-sided density averaged over half-overlapping segments, each without its mean and
    weighted by a periodic Hann window."""
    n = min(nperseg, x.shape[1])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n) if n > 1 else np.ones(1)
    total, count = 0.0, 0
    for at in range(0, x.shape[1] - n + 1, n - n // 2):
        part = x[:, at : at + n]
        total = total + np.abs(np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * window, axis=1)) ** 2
        count += 1
    psd = total / count / (fs * (window**2).sum())
    psd[:, 1 : None if n % 2 else -1] *= 2
    return np.fft.rfftfreq(n, 1 / fs), psd


def _morlet(n: int, fs: float, freq: float, w0: float) -> np.ndarray:
    """The wavelet's spectrum at the FFT's frequencies."""
    scale = (w0 + math.sqrt(2 + w0 * w0)) / (4 * math.pi * freq)
    omega = 2 * np.pi * np.fft.fftfreq(n, 1 / fs)
    return np.where(omega > 0, np.pi**-0.25 * math.sqrt(2 * np.pi * scale * fs) * np.exp(-0.5 * (scale * omega - w0) ** 2), 0.0)


def morlet_power(x: np.ndarray, fs: float, freqs: list[float], w0: float = MORLET_W0) -> np.ndarray:
    """Mean wavelet power (rows, freqs). By Parseval's identity no inverse transform is needed."""
    n = x.shape[1]
    power = np.abs(np.fft.fft(x - x.mean(axis=1, keepdims=True), axis=1)) ** 2
    return np.stack([(power * _morlet(n, fs, f, w0) ** 2).sum(axis=1) / n**2 for f in freqs], axis=1)


def morlet_series(x: np.ndarray, fs: float, freq: float, w0: float = MORLET_W0) -> np.ndarray:
    """Wavelet power at one frequency, sample by sample."""
    spectrum = np.fft.fft(x - x.mean(axis=1, keepdims=True), axis=1)
    return np.abs(np.fft.ifft(spectrum * _morlet(x.shape[1], fs, freq, w0), axis=1)) ** 2


def on_rows(kernel: Kernel, samples: Column) -> Column:
    """kernel applied to an array column, a whole Arrow batch at a time; rows of one length go together. Null stays null."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(column: pa.Array) -> pa.Array:
        rows = [None if v is None else np.asarray(v, float) for v in column.to_pylist()]
        lengths = np.array([-1 if r is None else len(r) for r in rows])
        out: list = [None] * len(rows)
        for n in np.unique(lengths[lengths >= 0]):
            own = np.flatnonzero(lengths == n)
            for i, y in zip(own, kernel(np.stack([rows[i] for i in own])), strict=True):
                out[i] = y
        return pa.array(out, pa.list_(pa.float64()))

    return run(samples)
