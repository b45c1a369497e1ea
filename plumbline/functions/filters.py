"""Filters over arrays of samples: zero-phase bandpass, and resampling by a rational factor. Each is one Arrow batch map."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def band_gain(n: int, fs: float, low: float, high: float, order: int) -> np.ndarray:
    """What a Butterworth bandpass of this order, run forwards and backwards, leaves of each of n samples' frequencies."""
    t = np.tan(np.pi * np.minimum(np.fft.rfftfreq(n), 0.4999999))
    a, b = math.tan(math.pi * low / fs), math.tan(math.pi * high / fs)
    with np.errstate(divide="ignore"):
        return 1 / (1 + ((t**2 - a * b) / (t * (b - a))) ** (2 * order))


def banded(x: np.ndarray, fs: float, low: float, high: float, order: int) -> np.ndarray:
    """The band of one array, its ends continued by their point reflection and joined by a line, so that they don't ring."""
    pad = min(len(x) - 1, round(2 * fs / max(low, 0.1)))
    if pad < 1:
        return np.zeros_like(x)
    long = np.r_[2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]
    long -= np.linspace(long[0], long[-1], len(long))
    return np.fft.irfft(np.fft.rfft(long) * band_gain(len(long), fs, low, high, order), len(long))[pad : pad + len(x)]


def bandpass(leads: Column, fs: float, low: float, high: float, order: int = 2) -> Column:
    """Every lead's band, array<array<double>>; nulls stay null. The upper end must be below half the rate."""
    if not 0 < low < high < fs / 2:
        raise ValueError(f"a band must lie inside 0 to {fs / 2} Hz: {low} to {high}")

    @F.pandas_udf("array<array<double>>")
    def of(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None else [None if x is None else banded(np.asarray(x, float), fs, low, high, order) for x in r])

    return of(leads)


def kernel(up: int, down: int) -> np.ndarray:
    """A low pass at the lower of both rates: a sinc under a Kaiser window of ten samples a side."""
    half = 10 * max(up, down)
    at = np.arange(-half, half + 1)
    h = np.sinc(at / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    return up * h / h.sum()


def resampled(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """One array at up / down times its rate: ceil(n * up / down) samples, zeros beyond its ends.

    Every sample that is kept is one product of neighbours with the taps of its phase; none between is worked out.
    """
    h, n = kernel(up, down), -(-len(x) * up // down)
    half = len(h) // 2
    reach = half // up + 1
    # Taps of each phase over the neighbours from reach before to reach after.
    at = half + np.arange(up)[:, None] - np.arange(-reach, reach + 1)[None, :] * up
    taps = np.where((at >= 0) & (at < len(h)), h[np.clip(at, 0, len(h) - 1)], 0.0)
    centre, phase = np.divmod(np.arange(n) * down, up)
    near = np.lib.stride_tricks.sliding_window_view(np.pad(np.asarray(x, float), reach), 2 * reach + 1)[centre]
    return (near * taps[phase]).sum(axis=1)


def resample(leads: Column, up: int, down: int) -> Column:
    """Every lead at up / down times its rate, array<array<double>>: ceil(n * up / down) samples."""
    shared = math.gcd(up, down)
    up, down = up // shared, down // shared

    @F.pandas_udf("array<array<double>>")
    def of(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None else [resampled(np.asarray(x, float), up, down) for x in r])

    return of(leads) if up != down else leads
