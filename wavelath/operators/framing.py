"""Frames of a fixed number of samples from packets of any length.

Packets keep their bytes until frames are cut. Where a packet begins in its channel's samples is a
running sum, taken in two levels: within chunks of sequence numbers, and over chunks, of which only one
row each is put in order. Packets are then cut into the parts that fall into each
frame, so rows stay as few as packets and frames, and only then are the bytes decoded. The last, partial frame is not given.

Order is by seq; of packets with the same seq by time and bytes, so none is lost. A null channel is a channel of its own,
and packets without seq come first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import packets as P
from ..functions.convert import SOURCES, decode, float_type, low64

#: Sequence numbers of a chunk.
CHUNK = 8192


def before(rows: DataFrame, value: Column, out: str, seq: str = "seq", ties: tuple[str, ...] = (), until: int | None = None) -> DataFrame:
    """rows with out (long): the sum of value over the channel's rows that come before by seq and ties.

    until: rows that begin at that sum or later may be left out; whole chunks of them never get to be shuffled.
    """
    # A struct of a null is no null, so rows without a channel or seq meet their sums.
    own = rows.withColumn("__v", value.cast("long")).withColumn("__g", F.struct("channel", F.expr(f"{seq} div {CHUNK}").alias("chunk")))
    sums = own.groupBy("__g").agg(F.sum("__v").alias("__s"))
    ahead = Window.partitionBy("__g.channel").orderBy("__g.chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__g", F.coalesce(F.sum("__s").over(ahead), F.lit(0)).alias("__b"))
    if until is not None:
        sums = sums.where(F.col("__b") < until)
    inner = Window.partitionBy("__g").orderBy(seq, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return own.join(sums, "__g").withColumn(out, F.col("__b") + F.coalesce(F.sum("__v").over(inner), F.lit(0))).drop("__v", "__g", "__b")


def ragged(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def arrays(dtype: str) -> tuple[list[str], pa.DataType, str]:
    """Sample columns of a type, and the type of their numbers for Arrow and for Spark."""
    single = float_type(dtype) is np.float32
    return ["re", "im"] if dtype.startswith("c") else ["x"], pa.float32() if single else pa.float64(), "float" if single else "double"


def frames(parsed: DataFrame, size: int, dtype: str = "cf64", byteswap: bool = True, source: str = "i2") -> DataFrame:
    """channel, frame, ts (of the packet with the frame's first sample), and the sample arrays, size long, of parsed packets (channel, seq, sec, frac, payload)."""
    if size < 1:
        raise ValueError("size must be positive")
    cols, kind, name = arrays(dtype)
    unit = SOURCES[source] * len(cols)
    rows = parsed.select("channel", "seq", F.coalesce("sec", F.lit(0)).cast("long").alias("sec"), F.coalesce(low64("frac"), F.lit(0)).alias("frac"), F.col("payload").alias("data"))
    rows = rows.withColumn("n", F.coalesce(F.expr(f"length(data) div {unit}"), F.lit(0)).cast("long"))
    rows = before(rows, F.col("n"), "at", ties=("sec", "frac", "data")).where("n > 0")
    rows = rows.withColumn("frame", F.explode(F.expr(f"sequence(at div {size}, (at + n - 1) div {size})")))
    start = F.greatest(F.col("frame") * size - F.col("at"), F.lit(0))
    stop = F.least((F.col("frame") + 1) * size - F.col("at"), F.col("n"))
    part = F.struct((F.col("at") + start).alias("pos"), "sec", "frac", F.substring("data", (start * unit + 1).cast("int"), ((stop - start) * unit).cast("int")).alias("data"))
    held = rows.select("channel", "frame", part.alias("p"), (stop - start).alias("len")).groupBy("channel", "frame").agg(F.sort_array(F.collect_list("p")).alias("p"), F.sum("len").alias("len")).where(F.col("len") == size)
    ts = F.struct(F.col("p")[0]["sec"].alias("sec"), F.col("p")[0]["frac"].alias("ps"))

    def run(batches):
        for b in batches:
            lists = b.column("data")
            flat, ends = lists.flatten().to_pylist(), np.cumsum([0, *(len(x) for x in lists)])
            values = [decode(b"".join(flat[i:j]), dtype, source, byteswap) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            out = [ragged([v[k :: len(cols)] for v in values], kind) for k in range(len(cols))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("channel", "frame", "ts")), *out], ["channel", "frame", "ts", *cols])

    schema = "channel string, frame long, ts struct<sec:bigint,ps:bigint>, " + ", ".join(f"{c} array<{name}>" for c in cols)
    return held.select("channel", "frame", ts.alias("ts"), F.col("p.data").alias("data")).mapInArrow(run, schema)


def stov(packets: DataFrame, output_size: int, transport: str = "vita49", dtype: str = "cf64", byteswap: bool = True) -> DataFrame:
    """Frames of output_size samples (complex) or numbers (real) from packets (channel, seq, pkt)."""
    return frames(P.parse(packets, transport), output_size, dtype, byteswap)
