"""Tapers, transforms, power spectra and smoothing: numpy kernels, and native forms for short frames and SQL."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Coefficients of the tapers.
BLACKMAN_HARRIS = (0.35875, 0.48829, 0.14128, 0.01168)
HAMMING = (0.54, 0.46)
WINDOWS = ("blackman_harris", "hamming")
DB = 10 / math.log2(10)


def window(name: str, n: int, dtype=np.float64) -> np.ndarray:
    """Taper of n coefficients: Blackman-Harris is periodic, Hamming symmetric. Names may be in capitals.

    Factors are rounded to dtype first, cosines are double, and the sum is rounded to dtype.
    """
    given, name = name, name.lower()
    if name not in WINDOWS:
        raise ValueError(f"window must be one of {WINDOWS}, not {given!r}")
    if n < (2 if name == "hamming" else 1):
        raise ValueError(f"{name} needs more than {n} coefficients")
    k = np.arange(n)
    if name == "hamming":
        a, b = (float(dtype(c)) for c in HAMMING)
        return (a - b * np.cos(2 * np.pi * k / (n - 1))).astype(dtype)
    x = 2 * np.pi * k / n
    signs = (1, -1, 1, -1)
    return sum(s * float(dtype(a)) * np.cos(j * x) for j, (s, a) in enumerate(zip(signs, BLACKMAN_HARRIS, strict=True))).astype(dtype)


def interleaved(w: np.ndarray) -> np.ndarray:
    """Each coefficient twice, for samples stored as real, imaginary, real ..."""
    return np.repeat(w, 2)


def power_sum(w: np.ndarray, rounded: bool = False) -> float:
    """Sum of squares; rounded: squares in single precision, which doubles then sum."""
    return float((w.astype(np.float32) ** 2).astype(np.float64).sum() if rounded else (w.astype(np.float64) ** 2).sum())


def shift(x: np.ndarray) -> np.ndarray:
    """Rotated left by half the length, rounded down (last axis)."""
    return np.roll(x, -(x.shape[-1] // 2), axis=-1)


def fft(re: np.ndarray, im: np.ndarray, taper: np.ndarray | None = None, shifted: bool = True) -> np.ndarray:
    """Forward transform of each row, not normalised, in the precision of re."""
    x = np.empty(re.shape, np.complex64 if re.dtype == np.float32 else np.complex128)
    x.real, x.imag = (re, im) if taper is None else (re * taper, im * taper)
    out = np.fft.fft(x)
    return shift(out) if shifted else out


def rfft(x: np.ndarray, taper: np.ndarray | None = None) -> np.ndarray:
    """Forward transform of real rows: n // 2 + 1 bins."""
    return np.fft.rfft(x if taper is None else x * taper)


def psd(spectrum: np.ndarray, sample_rate: float, window_sum: float) -> np.ndarray:
    """Decibels of |X|^2 / sample_rate / window_sum. A bin without power reports 0."""
    kind = np.float32 if spectrum.dtype == np.complex64 else np.float64
    p = (spectrum.real**2 + spectrum.imag**2).astype(kind) / kind(sample_rate) / kind(window_sum)
    out = p.copy()
    np.log2(p, out=out, where=p > 0)
    return out * kind(DB)


def ema(previous: np.ndarray, current: np.ndarray, alpha: float) -> np.ndarray:
    kind = current.dtype.type
    return kind(alpha) * current + kind(1 - alpha) * previous


# Native forms: arrays of doubles inside the plan.


def native_window(name: str, n: int) -> Column:
    return F.array(*map(F.lit, window(name, n).tolist()))


def native_shift(x: Column) -> Column:
    half = F.floor(F.size(x) / 2).cast("int")
    return F.concat(F.slice(x, half + 1, F.size(x)), F.slice(x, F.lit(1), half))


def native_db(power: Column) -> Column:
    """log2 of positive values times 10 / log2(10); zero, negative and NaN pass the logarithm by."""
    return F.when((power > 0) & ~F.isnan(power), F.log2(power)).otherwise(power) * F.lit(DB)


def native_power(re: Column, im: Column, sample_rate: float, window_sum: float) -> Column:
    return F.zip_with(re, im, lambda r, i: (r * r + i * i) / F.lit(float(sample_rate)) / F.lit(float(window_sum)))


def native_ema(previous: Column, current: Column, alpha: float) -> Column:
    return F.zip_with(previous, current, lambda p, c: F.lit(alpha) * c + F.lit(1 - alpha) * p)


def native_at(x: Column, pos: Column | int) -> Column:
    """The number at a place from 0; a place outside fails, as it does for a frame's own accessor."""
    pos = F.lit(pos) if isinstance(pos, int) else pos
    return F.when((pos >= 0) & (pos < F.size(x)), F.get(x, pos)).when(x.isNotNull() & pos.isNotNull(), F.raise_error(F.lit("place outside of the frame")))


def native_bytes(x: Column, single: bool = False) -> Column:
    """Bytes that a frame's numbers take."""
    return F.size(x).cast("long") * (4 if single else 8)


def register(spark: SparkSession) -> None:
    """SQL functions on array columns: wl_fft(re, im), wl_rfft(x), wl_psd(re, im, rate, window), wl_shift(x), wl_window(name, n), wl_apply(x, name), wl_window_sum(name, n), wl_ema(previous, current, alpha)."""

    def each(f, *cols):
        return pd.Series([f(*v) for v in zip(*cols, strict=True)])

    def parts(rows) -> pd.DataFrame:
        return pd.DataFrame({"re": [x.real.tolist() for x in rows], "im": [x.imag.tolist() for x in rows]})

    array = lambda v: np.asarray(v, float)

    def db(r, i, rate, name):
        taper = window(name, len(r)) if name else None
        return psd(fft(array(r), array(i), taper, shifted=False), rate, power_sum(taper) if name else float(len(r))).tolist()

    @F.pandas_udf("struct<re:array<double>,im:array<double>>")
    def wl_fft(re: pd.Series, im: pd.Series) -> pd.DataFrame:
        return parts([fft(array(r), array(i), shifted=False) for r, i in zip(re, im, strict=True)])

    @F.pandas_udf("struct<re:array<double>,im:array<double>>")
    def wl_rfft(x: pd.Series) -> pd.DataFrame:
        return parts([rfft(array(v)) for v in x])

    @F.pandas_udf("array<double>")
    def wl_psd(re: pd.Series, im: pd.Series, rate: pd.Series, name: pd.Series) -> pd.Series:
        return each(db, re, im, rate, name)

    @F.pandas_udf("array<double>")
    def wl_shift(x: pd.Series) -> pd.Series:
        return each(lambda v: shift(array(v)).tolist(), x)

    @F.pandas_udf("array<double>")
    def wl_window(name: pd.Series, n: pd.Series) -> pd.Series:
        return each(lambda a, b: window(a, int(b)).tolist(), name, n)

    @F.pandas_udf("array<double>")
    def wl_apply(x: pd.Series, name: pd.Series) -> pd.Series:
        return each(lambda v, a: (array(v) * window(a, len(v))).tolist(), x, name)

    @F.pandas_udf("double")
    def wl_window_sum(name: pd.Series, n: pd.Series) -> pd.Series:
        return each(lambda a, b: power_sum(window(a, int(b))), name, n)

    @F.pandas_udf("array<double>")
    def wl_ema(previous: pd.Series, current: pd.Series, alpha: pd.Series) -> pd.Series:
        return each(lambda p, c, a: ema(array(p), array(c), a).tolist(), previous, current, alpha)

    for f in (wl_fft, wl_rfft, wl_psd, wl_shift, wl_window, wl_apply, wl_window_sum, wl_ema):
        spark.udf.register(f.__name__ if hasattr(f, "__name__") else f._name, f)
