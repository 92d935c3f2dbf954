"""Amplitude histograms of the real parts, given each time a window has more samples than the sample rate.

A window closes after the whole block that brings it over the rate; that block
counts in it, and the next window starts empty. Only one narrow row per block is put in
order, and it streams through in constant memory: when windows close depends on all
blocks before. Samples are counted where they lie, one array of counts for each window of an Arrow batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_of(value: Column, adc_bits: int) -> Column:
    """Bin of a sample; samples beyond the range count in the first and last bin."""
    size = 1 << adc_bits
    return F.greatest(F.lit(0), F.least(F.lit(size - 1), value + size // 2)).cast("int")


def counted(values: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(np.clip(values.astype(np.int64) + size // 2, 0, size - 1), minlength=size)


def windows(blocks: DataFrame, sample_rate: int) -> DataFrame:
    """channel, block_seq, win, closes (whether the window ends with the block) of blocks (channel, block_seq, n); the window open at the end has no closing block."""
    rate = int(sample_rate)

    def fold(batches):
        now, total, win = object(), 0, 0
        for b in batches:
            channels, wins, closes = b.column("channel").to_pylist(), [], []
            for channel, n in zip(channels, b.column("n").to_pylist(), strict=True):
                if channel != now:
                    now, total, win = channel, 0, 0
                total += n
                wins.append(win)
                closes.append(total > rate)
                if total > rate:
                    total, win = 0, win + 1
            yield pa.RecordBatch.from_arrays([b.column("channel"), b.column("block_seq"), pa.array(wins, pa.int64()), pa.array(closes, pa.bool_())], ["channel", "block_seq", "win", "closes"])

    rows = blocks.select("channel", "block_seq", F.col("n").cast("long").alias("n")).repartition("channel").sortWithinPartitions("channel", "block_seq")
    return rows.mapInArrow(fold, "channel string, block_seq long, win long, closes boolean")


def histogram(samples: DataFrame, adc_bits: int, sample_rate: int) -> DataFrame:
    """channel, win, ts (of the closing block), counts (array of 2**adc_bits) from samples (channel, block_seq, recv_sec, recv_ps, i: array of int).

    The last window is given only if it closed. A null channel is a channel of its own; null samples count as none.
    """
    size = 1 << adc_bits
    own = samples.withColumn("i", F.filter(F.coalesce("i", F.array().cast("array<int>")), lambda x: x.isNotNull()))
    wins = windows(own.groupBy("channel", "block_seq").agg(F.sum(F.size("i")).alias("n")), sample_rate)
    wins = wins.withColumnsRenamed({"channel": "c", "block_seq": "b"})
    rows = own.join(wins, F.col("channel").eqNullSafe(F.col("c")) & (F.col("block_seq") == F.col("b")))

    def count(batches):
        for b in batches:
            keys = list(zip(b.column("channel").to_pylist(), b.column("win").to_pylist(), strict=True))
            lists = b.column("i")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(len(x) for x in lists)])
            sums: dict[tuple, np.ndarray] = {}
            for k, key in enumerate(keys):
                sums.setdefault(key, np.zeros(size, np.int64))
                sums[key] += counted(flat[ends[k] : ends[k + 1]], size)
            for (channel, win), n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([channel] * len(at), pa.string()), pa.array([win] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["channel", "win", "bin", "n"])

    ts = rows.where("closes").groupBy("channel", "win").agg(F.min(F.struct(F.col("recv_sec").alias("sec"), F.col("recv_ps").alias("ps"))).alias("ts"))
    counts = rows.select("channel", "win", "i").mapInArrow(count, "channel string, win long, bin int, n long").groupBy("channel", "win", "bin").agg(F.sum("n").alias("n"))
    found = counts.groupBy("channel", "win").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0)).cast("long"))
    found = found.select(F.col("channel").alias("c"), F.col("win").alias("w"), dense.alias("counts"))
    none = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.lit(0).cast("long"))
    closed = ts.join(found, F.col("channel").eqNullSafe(F.col("c")) & (F.col("win") == F.col("w")), "left")
    return closed.select("channel", "win", "ts", F.coalesce("counts", none).alias("counts"))


def real_parts(data: DataFrame, byteswap: bool) -> DataFrame:
    """channel, block_seq, recv_sec, recv_ps, i of parsed packets."""
    from ..functions.convert import decode

    def run(batches):
        for b in batches:
            parts = [decode((x or b"")[: len(x or b"") // 4 * 4], "cf64", byteswap=byteswap)[::2] for x in b.column("payload").to_pylist()]
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            flat = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("channel", "block_seq", "recv_sec", "recv_ps")), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["channel", "block_seq", "recv_sec", "recv_ps", "i"])

    return data.select("channel", "block_seq", "recv_sec", "recv_ps", "payload").mapInArrow(run, "channel string, block_seq long, recv_sec long, recv_ps long, i array<int>")


def from_packets(packets: DataFrame, msg_size: int, num_msgs: int, adc_bits: int, sample_rate: int, transport: str = "vita49", byteswap: bool = True) -> DataFrame:
    """histogram of packets received in blocks of num_msgs slots of msg_size bytes."""
    from ..functions import packets as P

    slots = P.slots(P.block(packets, msg_size, num_msgs), msg_size)
    return histogram(real_parts(P.parse(slots, transport), byteswap), adc_bits, sample_rate)
