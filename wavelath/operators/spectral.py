"""Windowed transform, shift and power spectrum of frames, fused in one pass over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spectral as S
from ..functions.convert import float_type


def matrix(column: pa.Array, kind) -> np.ndarray:
    """List column of equal lengths as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def lists(x: np.ndarray) -> pa.Array:
    offsets = np.arange(x.shape[0] + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(x).ravel()))


#: Numbers in an Arrow batch of frames.
BATCH = 1 << 21


def bounded(frames: DataFrame, size: int) -> None:
    """Lowers the session's rows per Arrow batch where frames are long, so that a batch stays within tens of MB."""
    conf, key = frames.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    most = max(1, BATCH // max(1, size))
    if not 0 < int(conf.get(key, "10000")) <= most:
        conf.set(key, str(most))


def _run(frames: DataFrame, size: int, kernel, out: list[str], dtype: str) -> DataFrame:
    kind = float_type(dtype)
    name = "float" if kind is np.float32 else "double"
    bounded(frames, size)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            re, im = matrix(b.column("re"), kind), matrix(b.column("im"), kind)
            if re.shape[1] != size or im.shape != re.shape:
                raise ValueError(f"frames of {re.shape[1]} samples where fft_size is {size}")
            yield pa.RecordBatch.from_arrays([b.column("channel"), b.column("frame"), b.column("ts"), *map(lists, kernel(re, im))], ["channel", "frame", "ts", *out])

    schema = "channel string, frame long, ts struct<sec:bigint,ps:bigint>, " + ", ".join(f"{c} array<{name}>" for c in out)
    # Empty messages are passed over.
    return frames.where("size(re) > 0").select("channel", "frame", "ts", "re", "im").mapInArrow(run, schema)


def fft(frames: DataFrame, fft_size: int = 1024, window: str = "", shift: bool = True, dtype: str = "cf64", fftw_threads: int = 1) -> DataFrame:
    """Spectra of frames; without a window the taper is left out of the plan. fftw_threads is accepted: frames are the parallelism."""
    kind = float_type(dtype)
    taper = S.window(window, fft_size, kind) if window else None

    def kernel(re, im):
        x = S.fft(re, im, taper, shift)
        return x.real.astype(kind), x.imag.astype(kind)

    return _run(frames, fft_size, kernel, ["re", "im"], dtype)


def rfft(frames: DataFrame, fft_size: int, window: str = "", dtype: str = "f64") -> DataFrame:
    """Half spectra (fft_size // 2 + 1 bins) of real frames (x), not shifted: a shift of half a spectrum would part nothing."""
    kind = float_type(dtype)
    taper = S.window(window, fft_size, kind) if window else None

    def kernel(re, im):
        x = S.rfft(re, taper)
        return x.real.astype(kind), x.imag.astype(kind)

    return _run(frames.withColumnsRenamed({"x": "re"}).withColumn("im", F.col("re")), fft_size, kernel, ["re", "im"], dtype)


def window_sum(window: str, fft_size: int, dtype: str = "cf64", rounded: bool = False) -> float:
    """Power of the taper; "rectangular" is named where no taper was applied."""
    if window == "rectangular":
        return float(fft_size)
    return S.power_sum(S.window(window, fft_size, float_type(dtype)), rounded)


def psd(spectra: DataFrame, fft_size: int = 1024, window: str = "", sample_rate: float = 1.0, dtype: str = "f64", rounded: bool = False) -> DataFrame:
    """Decibels of each bin of spectra; rounded: the taper's squares are taken in single precision."""
    total = window_sum(window, fft_size, dtype, rounded)
    return _run(spectra, fft_size, lambda re, im: [S.psd(re + 1j * im, sample_rate, total)], ["psd"], dtype)


def spectra_db(frames: DataFrame, fft_size: int, window: str, sample_rate: float, shift: bool = True, dtype: str = "f64") -> DataFrame:
    """fft and psd at once: arrays cross to Python one time."""
    kind = float_type(dtype)
    taper = None if window == "rectangular" else S.window(window, fft_size, kind)
    total = window_sum(window, fft_size, dtype)
    return _run(frames, fft_size, lambda re, im: [S.psd(S.fft(re, im, taper, shift), sample_rate, total)], ["psd"], dtype)
