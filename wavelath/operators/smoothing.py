"""First-order smoothing of frames.

S_0 = x_0, S_k = a x_k + (1 - a) S_(k-1); frame k gives S_k, and the last frame of a
channel is held back, as a stream would hold it. The recurrence is affine: a run of frames takes the
state before it to decay * state + offset. So chunks of frames are reduced to their offsets side by side, runs of chunks
to those of theirs, the few runs are folded in order, then the chunks of each run, and
chunks are smoothed side by side from their states.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.convert import float_type
from ..functions.spectral import ema

#: Frames of a chunk, and chunks of a run.
CHUNK, RUN = 2048, 256


def smoothed(x: np.ndarray, alpha: float, state: np.ndarray | None) -> np.ndarray:
    """States after each row of x, from state (None: x starts)."""
    out = np.empty_like(x)
    for k, row in enumerate(x):
        state = row if state is None else ema(state, row, alpha)
        out[k] = state
    return out


def exp_smooth(frames: DataFrame, alpha: float = 1.0, value: str = "psd", dtype: str = "f64", chunk: int = CHUNK, run: int = RUN) -> DataFrame:
    """channel, frame, ts and the smoothed arrays. alpha 1 leaves frames as they are, the last one too. A null channel is a channel of its own."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be from 0 to 1")
    if alpha == 1:
        return frames.select("channel", "frame", "ts", value)
    kind = float_type(dtype)
    # Grouped by a text that no null takes part in: pandas would drop those groups.
    key = F.concat(F.when(F.col("channel").isNull(), "n").otherwise("c"), F.coalesce("channel", F.lit("")))
    rows = frames.select(key.alias("k"), "channel", "frame", "ts", F.col(value).alias("x"), F.expr(f"frame div {chunk}").alias("c"), F.expr(f"frame div {chunk * run}").alias("g"))

    def stacked(pdf: pd.DataFrame) -> np.ndarray:
        if pdf["x"].map(len).nunique() > 1:
            raise ValueError("frames of one channel must have one size")
        return np.stack(pdf["x"].to_numpy())

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        x = stacked(pdf).astype(float)
        weights = alpha * (1 - alpha) ** np.arange(len(x) - 1, -1, -1)
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "g": [pdf["g"].iloc[0]], "c": [pdf["c"].iloc[0]], "n": [len(x)], "start": [x[0].tolist()], "offset": [(weights @ x).tolist()]})

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        """A run's chunks as one."""
        pdf = pdf.sort_values("c")
        offset, n = 0.0, 0
        for own, more in zip(pdf["offset"], pdf["n"], strict=True):
            offset, n = np.asarray(own) + (1 - alpha) ** more * offset, n + more
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "g": [pdf["g"].iloc[0]], "n": [n], "start": [pdf["start"].iloc[0]], "offset": [offset.tolist()]})

    def fold(order: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
        """States before each row, in order, from the state that the first row has, or its first frame."""

        def states(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order)
            state, out = pdf["state"].iloc[0] if "state" in pdf else None, []
            for n, start, offset in zip(pdf["n"], pdf["start"], pdf["offset"], strict=True):
                out.append(None if state is None else np.asarray(state).tolist())
                state = np.asarray(offset) + (1 - alpha) ** n * np.asarray(start if state is None else state)
            return pd.DataFrame({"k": pdf["k"], order: pdf[order], "state": out})

        return states

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        state = pdf["state"].iloc[0]
        out = smoothed(stacked(pdf).astype(kind), alpha, None if state is None else np.asarray(state, kind))
        keep = (pdf["frame"] != pdf["last"]).to_numpy()
        ts = [{"sec": t["sec"], "ps": t["ps"]} if isinstance(t, dict) else t for t in pdf["ts"]]
        return pd.DataFrame({"channel": pdf["channel"], "frame": pdf["frame"], "ts": ts, value: list(out)})[keep]

    name = "float" if kind is np.float32 else "double"
    chunks = rows.groupBy("k", "c").applyInPandas(reduce, "k string, g long, c long, n long, start array<double>, offset array<double>")
    runs = chunks.groupBy("k", "g").applyInPandas(compose, "k string, g long, n long, start array<double>, offset array<double>")
    begun = runs.groupBy("k").applyInPandas(fold("g"), "k string, g long, state array<double>")
    states = chunks.join(begun, ["k", "g"]).groupBy("k", "g").applyInPandas(fold("c"), "k string, c long, state array<double>")
    last = rows.groupBy("k").agg(F.max("frame").alias("last"))
    return rows.join(states, ["k", "c"]).join(last, "k").groupBy("k", "c").applyInPandas(apply, f"channel string, frame long, ts struct<sec:bigint,ps:bigint>, {value} array<{name}>")
