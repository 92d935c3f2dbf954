"""Framing, smoothing and histograms as keyed stateful streams.

State is one row per channel: the bytes of the unfinished frame, the last
smoothed frame, or the open histogram. Rows of a micro-batch are put in seq order
within a channel; batches have to come in order. What batch operators give for the same
packets, these give over any split into micro-batches. (A histogram's block of packets
counts as received once it is full or a later one begins, so the last one may wait.) Frames are cut
out of a micro-batch's bytes at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import packets as P
from ..functions.convert import SOURCES, decode, low64
from ..functions.spectral import ema
from ..operators.framing import arrays
from ..operators.histogram import counted
from ..shared import fresh_path

NONE = GroupStateTimeout.NoTimeout


class Framer:
    """Frames of size elements, of unit bytes each, out of payloads that come one after the other."""

    def __init__(self, size: int, unit: int, frame: int = 0, rest: bytes = b"", sec: int = 0, frac: int = 0):
        self.size, self.unit, self.frame, self.rest, self.sec, self.frac = size, unit, frame, rest, sec, frac

    def push(self, payloads: list[bytes], secs, fracs) -> list[tuple[int, int, int, bytes]]:
        """frame, sec and frac of the packet with its first element, and bytes of each frame that fills up."""
        cut = [p[: len(p) // self.unit * self.unit] for p in payloads]
        data, full = b"".join([self.rest, *cut]), self.size * self.unit
        # Where each packet ends; the one that ends first beyond a frame's start holds its first element.
        ends = np.cumsum([len(self.rest), *map(len, cut)])
        sec, frac = [self.sec, *secs], [self.frac, *fracs]
        n = len(data) // full
        owner = np.searchsorted(ends, np.arange(n + 1) * full, "right")
        out = [(self.frame + k, sec[owner[k]], frac[owner[k]], data[k * full : (k + 1) * full]) for k in range(n)]
        self.frame, self.rest = self.frame + n, data[n * full :]
        if self.rest:
            self.sec, self.frac = sec[owner[n]], frac[owner[n]]
        return out


def stov(packets: DataFrame, output_size: int, transport: str = "vita49", byteswap: bool = True, dtype: str = "cf64") -> DataFrame:
    """channel, frame, ts and the sample arrays of streaming packets."""
    cols, _, name = arrays(dtype)
    unit = SOURCES["i2"] * len(cols)
    rows = P.parse(packets, transport).select("channel", "seq", F.coalesce("sec", F.lit(0)).cast("long").alias("sec"), F.coalesce(low64("frac"), F.lit(0)).alias("frac"), F.coalesce("payload", F.lit(b"")).alias("payload"))

    def run(key, pdfs, state: GroupState):
        f = Framer(output_size, unit)
        if state.exists:
            frame, sec, frac, rest = state.get
            f = Framer(output_size, unit, frame, bytes(rest), sec, frac)
        rows = pd.concat(list(pdfs)).sort_values(["seq", "sec", "frac", "payload"])
        out = f.push([bytes(p) for p in rows["payload"]], rows["sec"].tolist(), rows["frac"].tolist())
        state.update((f.frame, int(f.sec), int(f.frac), f.rest))
        values = [decode(data, dtype, byteswap=byteswap) for *_, data in out]
        yield pd.DataFrame({"channel": [key[0]] * len(out), "frame": [x[0] for x in out], "sec": [x[1] for x in out], "ps": [x[2] for x in out]} | {c: [v[k :: len(cols)] for v in values] for k, c in enumerate(cols)})

    schema = "channel string, frame long, sec long, ps long, " + ", ".join(f"{c} array<{name}>" for c in cols)
    held = rows.groupBy("channel").applyInPandasWithState(run, schema, "frame long, sec long, frac long, rest binary", "append", NONE)
    return held.select("channel", "frame", F.struct("sec", "ps").alias("ts"), *cols)


def exp_smooth(frames: DataFrame, alpha: float, value: str = "psd", dtype: str = "f64") -> DataFrame:
    """channel, frame, ts and the smoothed arrays of streaming frames, each one frame late; alpha 1 passes frames through."""
    rows = frames.select("channel", "frame", "ts", value)
    if alpha == 1:
        return rows
    kind, name = (np.float32, "float") if dtype.endswith("32") else (np.float64, "double")

    def run(key, pdfs, state: GroupState):
        frame, sec, ps, last = state.get if state.exists else (None, 0, 0, None)
        last = None if last is None else np.array(last, kind)
        rows = pd.concat(list(pdfs)).sort_values("frame")
        if (lengths := rows["x"].map(len)).nunique() > 1 or last is not None and len(rows) and lengths.iloc[0] != len(last):
            raise ValueError("frames of one channel must have one size")
        out = {"channel": [], "frame": [], "sec": [], "ps": [], value: []}
        for now, s, p, x in zip(rows["frame"].tolist(), rows["sec"].tolist(), rows["ps"].tolist(), rows["x"], strict=True):
            x = np.asarray(x, kind)
            if last is not None:
                for column, v in zip(out.values(), (key[0], frame, sec, ps, last), strict=True):
                    column.append(v)
                x = ema(last, x, alpha)
            frame, sec, ps, last = now, s, p, x
        if last is not None:
            state.update((frame, sec, ps, last.tolist()))
        yield pd.DataFrame(out)

    flat = rows.select("channel", "frame", F.col("ts.sec").alias("sec"), F.col("ts.ps").alias("ps"), F.col(value).alias("x"))
    held = flat.groupBy("channel").applyInPandasWithState(run, f"channel string, frame long, sec long, ps long, {value} array<{name}>", f"frame long, sec long, ps long, psd array<{name}>", "append", NONE)
    return held.select("channel", "frame", F.struct("sec", "ps").alias("ts"), value)


def histogram(packets: DataFrame, msg_size: int, num_msgs: int, adc_bits: int, sample_rate: int, transport: str = "vita49", byteswap: bool = True) -> DataFrame:
    """channel, win, ts, counts of streaming packets, in blocks of num_msgs by seq."""
    if msg_size <= 0:
        raise ValueError("msg_size must be positive")
    size, rate = 1 << adc_bits, int(sample_rate)
    fill = F.unhex(F.rpad(F.hex(F.substring("pkt", 1, msg_size)), 2 * msg_size, P.SLOT_FILL))
    slots = packets.select("channel", "seq", "recv_sec", "recv_ps", fill.alias("pkt"))
    # Packets without samples take part in blocks, but give no payload.
    P.check_transport(transport)
    parsed = P.parse_sdds(slots) if transport == "sdds" else P.parse_v49(slots)
    rows = parsed.select("channel", "seq", "recv_sec", "recv_ps", F.coalesce("payload", F.lit(b"")).alias("payload"))

    def run(key, pdfs, state: GroupState):
        win, n, block, seen, sec, ps, counts = state.get if state.exists else (0, 0, None, 0, 0, 0, [0] * size)
        counts, out = np.array(counts, np.int64), []
        rows = pd.concat(list(pdfs)).sort_values("seq")

        def end() -> None:
            nonlocal win, n, block, seen, counts
            if n > rate:
                out.append((key[0], win, sec, ps, counts))
                win, n, counts = win + 1, 0, np.zeros(size, np.int64)
            block, seen = None, 0

        own = rows["seq"] // num_msgs
        for b, part in rows.groupby(own, sort=True):
            if block is not None and block != b:
                end()
            if block is None:
                block, sec, ps = int(b), int(part["recv_sec"].iloc[0]), int(part["recv_ps"].iloc[0])
            values = np.concatenate([decode(bytes(p)[: len(p) // 4 * 4], "cf64", byteswap=byteswap)[::2] for p in part["payload"]])
            counts, n, seen = counts + counted(values, size), n + len(values), seen + len(part)
            if seen >= num_msgs:
                end()
        state.update((win, n, block, seen, sec, ps, counts.tolist()))
        yield pd.DataFrame(out, columns=["channel", "win", "sec", "ps", "counts"])

    held = rows.groupBy("channel").applyInPandasWithState(run, "channel string, win long, sec long, ps long, counts array<long>", "win long, n long, block long, seen long, sec long, ps long, counts array<long>", "append", NONE)
    return held.select("channel", "win", F.struct("sec", "ps").alias("ts"), "counts")


def histogram_blocks(samples: DataFrame, adc_bits: int, sample_rate: int) -> DataFrame:
    """channel, win, ts, counts of streaming blocks (channel, block_seq, recv_sec, recv_ps, i)."""
    size, rate = 1 << adc_bits, int(sample_rate)

    def run(key, pdfs, state: GroupState):
        win, n, counts = state.get if state.exists else (0, 0, [0] * size)
        counts, out = np.array(counts, np.int64), []
        rows = pd.concat(list(pdfs)).sort_values("block_seq")
        for sec, ps, i in zip(rows["recv_sec"].tolist(), rows["recv_ps"].tolist(), rows["i"], strict=True):
            v = np.asarray(i, np.int64)
            counts, n = counts + counted(v, size), n + len(v)
            if n > rate:
                out.append((key[0], win, sec, ps, counts))
                win, n, counts = win + 1, 0, np.zeros(size, np.int64)
        state.update((win, int(n), counts.tolist()))
        yield pd.DataFrame(out, columns=["channel", "win", "sec", "ps", "counts"])

    held = samples.select("channel", "block_seq", "recv_sec", "recv_ps", "i").groupBy("channel").applyInPandasWithState(run, "channel string, win long, sec long, ps long, counts array<long>", "win long, n long, counts array<long>", "append", NONE)
    return held.select("channel", "win", F.struct("sec", "ps").alias("ts"), "counts")


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what is there now, into Parquet files of the shared folder, and gives its rows."""
    spark = stream.sparkSession
    path = fresh_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")

