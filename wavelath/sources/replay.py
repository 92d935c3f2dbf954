"""Stored packets, and the packets and frames that the driver's tables stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import packets as P

PACKETS = "channel string, seq long, pkt binary, recv_sec long, recv_ps long"
EPOCH = 1704067200
SAMPLES_A_PACKET = 256


def replay(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Packets of Parquet files, as a batch or one file a micro-batch."""
    if streaming:
        return spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", 1).parquet(path)
    return spark.read.schema(PACKETS).parquet(path)


def iq_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, pkt, i, q: 16-bit samples from events, 256 in a packet."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("pos"), F.expr(f"event_id div {SAMPLES_A_PACKET}").alias("pkt"), (F.floor("value").cast("int") - 245).alias("i"), (F.col("user_id") % 1000).cast("int").alias("q"))


def v49_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VITA-49 packets of iq_samples: every fifth is context, class ids and trailers come and go."""
    hex_ = F.concat(P.number(F.pmod("i", F.lit(65536)).cast("long"), 2), P.number(F.pmod("q", F.lit(65536)).cast("long"), 2))
    held = iq_samples(spark, sf_dir).groupBy("pkt").agg(F.sort_array(F.collect_list(F.struct("pos", hex_.alias("h")))).alias("s"))
    payload = F.array_join(F.transform("s", lambda x: x["h"]), "")
    ptype = F.when(F.col("pkt") % 5 == 4, 4).otherwise(1)
    pkt = P.encode_v49(ptype, F.col("pkt") % 3 == 0, F.col("pkt") % 2 == 1, 1, 2, F.lit(77), F.lit("0012345600010002"), F.col("pkt") + EPOCH, F.col("pkt") * 1_000_000, payload)
    return held.select(F.lit("0").alias("channel"), F.col("pkt").alias("seq"), pkt.alias("pkt"), (F.col("pkt") + EPOCH).alias("recv_sec"), F.lit(0).cast("long").alias("recv_ps"))


#: Fixed value: SDDS time tags of packets that stand for events, in ticks between packets and of the first one.
SDDS_STEP, SDDS_FIRST = 40_000_000_003, 123


def sdds_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SDDS packets of iq_samples, 256 in each; the last one is filled up with zeros."""
    pair = F.concat(P.number(F.pmod("i", F.lit(65536)).cast("long"), 2), P.number(F.pmod("q", F.lit(65536)).cast("long"), 2))
    held = iq_samples(spark, sf_dir).groupBy("pkt").agg(F.sort_array(F.collect_list(F.struct("pos", pair.alias("h")))).alias("s"))
    payload = F.rpad(F.array_join(F.transform("s", lambda x: x["h"]), ""), 2 * P.SDDS_PAYLOAD, "0")
    ticks = F.col("pkt") * F.lit(SDDS_STEP) + SDDS_FIRST
    pkt = F.unhex(F.concat(F.lit("00" * 8), P.number(ticks, 8), P.number(F.col("pkt") * 7, 4), F.lit("00" * 36), payload))
    return held.select(F.lit("0").alias("channel"), F.col("pkt").alias("seq"), pkt.alias("pkt"), (F.col("pkt") + EPOCH).alias("recv_sec"), F.lit(0).cast("long").alias("recv_ps"))


def complex_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of half as many complex samples as an embedding has numbers, which are real, imaginary, real ..."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    lane = lambda odd: F.transform(F.filter("embedding", lambda _, k: k % 2 == odd), lambda x: x.cast("double"))
    ts = F.struct(F.col("vec_id").alias("sec"), F.lit(0).cast("long").alias("ps"))
    return e.select(F.lit("0").alias("channel"), F.col("vec_id").alias("frame"), ts.alias("ts"), lane(0).alias("re"), lane(1).alias("im"))


def real_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    ts = F.struct(F.col("vec_id").alias("sec"), F.lit(0).cast("long").alias("ps"))
    return e.select(F.lit("0").alias("channel"), F.col("vec_id").alias("frame"), ts.alias("ts"), F.col("embedding").cast("array<double>").alias("psd"))
