"""Packet layouts as native column expressions.

Parsing is schema-on-read over a BINARY column: nothing here is Python at run
time, so filters on header fields run before any decoding. VITA-49 first word:
bits 31-28 type, 27 class id, 26 trailer, 23-22 and 21-20 the kinds of integer
and fractional time, 15-0 size in words. SDDS: time tag at byte 8 in units of 250 ps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the layouts.
SDDS_HEADER, SDDS_PAYLOAD = 56, 1024
SDDS_TICKS_A_SECOND, SDDS_TICK_PS = 4_000_000_000, 250
SIGNAL_DATA, SIGNAL_DATA_STREAM_ID, CONTEXT = 0, 1, 4
TRANSPORTS = ("sdds", "vita49")
SLOT_FILL = "FF"


def unsigned(data: Column, at, size: int) -> Column:
    """Big-endian unsigned integer of size bytes at zero-based place at; null where data ends before."""
    at = F.lit(at) if isinstance(at, int) else at
    text = F.hex(F.substring(data, at + 1, F.lit(size)))
    value = F.conv(text, 16, 10).cast("decimal(20,0)" if size > 7 else "long")
    return F.when(F.length(data) >= at + size, value)


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row however often body names it."""
    return F.transform(F.array(value), body)[0]


def fields(word: Column) -> Column:
    """STRUCT of a first word's fields; null for none."""
    field = lambda shift, bits: F.shiftrightunsigned(word, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    parts = {"ptype": (28, 4), "has_class": (27, 1), "has_trailer": (26, 1), "tsi": (22, 2), "tsf": (20, 2), "packet_count": (16, 4), "words": (0, 16)}
    return F.when(word.isNotNull(), F.struct(*(field(*p).alias(n) for n, p in parts.items())))


def v49_header(pkt: Column) -> Column:
    """STRUCT of the first word's fields; null for fewer than 4 bytes."""
    return let(unsigned(pkt, 0, 4), fields)


def is_data(header: Column) -> Column:
    return header["ptype"].isin(SIGNAL_DATA, SIGNAL_DATA_STREAM_ID)


def is_context(header: Column) -> Column:
    return header["ptype"] == CONTEXT


def parse_v49(packets: DataFrame, pkt: str = "pkt") -> DataFrame:
    """packets with header, stream_id, class_id, sec, frac, trailer, payload and _corrupt.

    Optional fields are null where absent. The payload of packets that aren't
    data is empty. A packet that claims more bytes than it has is cut to what is
    there and marked in _corrupt, as is one without a header.
    """
    p = F.col(pkt)

    def positions(h: Column) -> Column:
        """Where each field begins, 4 bytes on if there is no header."""
        stream = F.when(h["ptype"] != SIGNAL_DATA, 4).otherwise(0)
        cls = F.when(h["has_class"] == 1, 8).otherwise(0)
        seconds = F.when(h["tsi"] != 0, 4).otherwise(0)
        more = F.when(h["tsf"] != 0, 8).otherwise(0)
        ends = {"cls": 4 + stream, "int": 4 + stream + cls, "frac": 4 + stream + cls + seconds, "payload": 4 + stream + cls + seconds + more}
        return F.struct(*(v.alias(k) for k, v in ends.items()), (h["words"] * 4).alias("claimed"), is_data(h).alias("data"), ((h["has_trailer"] == 1) & is_data(h)).alias("trailer"))

    def parsed(h: Column, at: Column) -> Column:
        size = F.greatest(F.least(at["claimed"], F.length(p)) - at["payload"] - F.when(at["trailer"], 4).otherwise(0), F.lit(0))
        return F.struct(
            h.alias("header"),
            F.when(h["ptype"] != SIGNAL_DATA, unsigned(p, 4, 4)).alias("stream_id"),
            F.when((h["has_class"] == 1) & (F.length(p) >= at["cls"] + 8), F.substring(p, at["cls"] + 1, F.lit(8))).alias("class_id"),
            F.when(h["tsi"] != 0, unsigned(p, at["int"], 4)).alias("sec"),
            F.when(h["tsf"] != 0, unsigned(p, at["frac"], 8)).alias("frac"),
            F.when(at["trailer"] & (at["claimed"] >= at["payload"] + 4), unsigned(p, F.greatest(at["claimed"] - 4, F.lit(0)), 4)).alias("trailer"),
            F.when(at["data"], F.substring(p, at["payload"] + 1, size)).otherwise(F.lit(b"")).alias("payload"),
            (h.isNull() | (at["claimed"] > F.length(p)) | (at["claimed"] < at["payload"])).alias("_corrupt"),
        )

    # Nested so that plans stay small: written out as columns of columns, each field would hold all those before it many times over.
    whole = let(unsigned(p, 0, 4), lambda w: let(fields(w), lambda h: let(positions(h), lambda at: parsed(h, at))))
    names = ("header", "stream_id", "class_id", "sec", "frac", "trailer", "payload", "_corrupt")
    return packets.withColumn("__p", whole).select(*(F.col(f"`{c}`") for c in packets.columns), *(F.col(f"__p.{n}").alias(n) for n in names))


def parse_sdds(packets: DataFrame, pkt: str = "pkt") -> DataFrame:
    """packets with ttag, ttage, sec (32 bits of the seconds), frac (what ttag has beyond sec, in picoseconds, 64 bits), payload and _corrupt."""
    p = F.col(pkt)
    rows = packets.withColumn("ttag", unsigned(p, 8, 8)).withColumn("ttage", unsigned(p, 16, 4))
    rows = rows.withColumn("sec", F.expr(f"cast((ttag div {SDDS_TICKS_A_SECOND}) % {1 << 32} as long)"))
    ps = f"cast(ttag as decimal(38,0)) * {SDDS_TICK_PS} - cast(sec as decimal(38,0)) * {SDDS_TICKS_A_SECOND * SDDS_TICK_PS}"
    return rows.select(
        "*",
        F.expr(f"cast(({ps}) % {1 << 64} as decimal(20,0))").alias("frac"),
        F.substring(p, SDDS_HEADER + 1, SDDS_PAYLOAD).alias("payload"),
        F.coalesce(F.length(p) < SDDS_HEADER + SDDS_PAYLOAD, F.lit(True)).alias("_corrupt"),
    )


def check_transport(transport: str) -> None:
    if transport not in TRANSPORTS:
        raise ValueError(f"transport must be one of {TRANSPORTS}, not {transport!r}")


def parse(packets: DataFrame, transport: str, pkt: str = "pkt") -> DataFrame:
    """Data packets of a transport, with sec, frac and payload."""
    check_transport(transport)
    if transport == "sdds":
        return parse_sdds(packets, pkt)
    # The type is the first digit: told before a packet is taken apart, so that the filter gets down to the scan as it stands.
    kind = F.substring(F.hex(F.substring(F.col(pkt), 1, 1)), 1, 1)
    data = packets.where(kind.isin(str(SIGNAL_DATA), str(SIGNAL_DATA_STREAM_ID)) & (F.length(pkt) >= 4))
    return parse_v49(data, pkt)


def slots(blocks: DataFrame, msg_size: int, data: str = "data") -> DataFrame:
    """One row per slot of msg_size bytes of each block: slot and pkt beside the block's other columns."""
    if msg_size <= 0:
        raise ValueError("msg_size must be positive")
    rest = [c for c in blocks.columns if c != data]
    rows = blocks.where(F.length(data) > 0).select(*rest, data, F.explode(F.sequence(F.lit(0), F.floor((F.length(data) - 1) / msg_size).cast("int"))).alias("slot"))
    return rows.select(*rest, "slot", F.substring(F.col(data), F.col("slot") * msg_size + 1, F.lit(msg_size)).alias("pkt"))


def block(packets: DataFrame, msg_size: int, num_msgs: int, pkt: str = "pkt") -> DataFrame:
    """Blocks of num_msgs packets by seq, each packet cut or filled with 0xFF to msg_size: channel, block_seq, recv_sec, recv_ps, data."""
    fill = F.unhex(F.rpad(F.hex(F.substring(F.col(pkt), 1, msg_size)), 2 * msg_size, SLOT_FILL))
    rows = packets.select("channel", "seq", "recv_sec", "recv_ps", fill.alias("slot"), F.expr(f"seq div {num_msgs}").alias("block_seq"))
    held = rows.groupBy("channel", "block_seq").agg(F.min_by("recv_sec", "seq").alias("recv_sec"), F.min_by("recv_ps", "seq").alias("recv_ps"), F.sort_array(F.collect_list(F.struct("seq", "slot"))).alias("s"))
    data = F.unhex(F.array_join(F.transform("s", lambda x: F.hex(x["slot"])), ""))
    return held.select("channel", "block_seq", "recv_sec", "recv_ps", data.alias("data"))


def number(value: Column, size: int) -> Column:
    """Hex text of the low size bytes of an integer, big-endian."""
    return F.lpad(F.right(F.hex(value), F.lit(2 * size)), 2 * size, "0")


def encode_v49(ptype: Column, has_class: Column, has_trailer: Column, tsi: int, tsf: int, stream_id: Column, class_hex: Column, sec: Column, frac: Column, payload_hex: Column) -> Column:
    """A packet as BINARY from its fields; payload and class id come as hex text."""
    none = F.lit("")
    trailer = has_trailer & ptype.isin(SIGNAL_DATA, SIGNAL_DATA_STREAM_ID)
    body = F.concat(F.when(ptype != SIGNAL_DATA, number(stream_id, 4)).otherwise(none), F.when(has_class, class_hex).otherwise(none), number(sec, 4) if tsi else none, number(frac, 8) if tsf else none, payload_hex, F.when(trailer, F.lit("00000000")).otherwise(none))
    bit = lambda c, n: F.when(c, F.lit(1 << n)).otherwise(F.lit(0))
    word = F.shiftleft(ptype.cast("long"), 28) + bit(has_class, 27) + bit(trailer, 26) + F.lit(tsi << 22 | tsf << 20) + 1 + F.floor(F.length(body) / 8)
    return F.unhex(F.concat(number(word.cast("long"), 4), body))
