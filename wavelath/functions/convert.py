"""Integer samples from bytes: raw counts, unscaled, of either byte order.

native_* stay in the plan as column expressions; decode_* read whole Arrow
batches with numpy and are the fast way for full payloads.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: numpy kinds that convert to 32- and to 64-bit floats.
TO_32 = ("u2", "i2", "u4", "i4")
TO_64 = (*TO_32, "u8", "i8")
#: Bytes of each kind.
SOURCES = {kind: int(kind[1]) for kind in TO_64}
FLOATS = {"f32": np.float32, "f64": np.float64, "cf32": np.float32, "cf64": np.float64}


def float_type(dtype: str) -> type:
    if dtype not in FLOATS:
        raise ValueError(f"dtype must be one of {tuple(FLOATS)}, not {dtype!r}")
    return FLOATS[dtype]


def decode(payload: bytes, dtype: str = "cf64", source: str = "i2", byteswap: bool = True) -> np.ndarray:
    """Floats of the whole integers in payload, interleaved as they come; byteswap: they are big-endian."""
    kind = float_type(dtype)
    if source not in (TO_32 if kind is np.float32 else TO_64):
        raise ValueError(f"no conversion from {source!r} to {dtype}")
    size = int(source[1])
    return np.frombuffer(payload, (">" if byteswap else "<") + source, len(payload) // size).astype(kind)


def signed(value: Column, bits: int) -> Column:
    """An unsigned integer's bits read as two's complement, without overflow under ANSI rules."""
    half = 1 << (bits - 1)
    return (value + half) % (1 << bits) - half


def low64(value: str) -> Column:
    """A decimal's low 64 bits as a long, so that no unsigned value overflows."""
    half, full = 1 << 63, 1 << 64
    return F.expr(f"cast(pmod(cast({value} as decimal(38,0)) + {half}BD, {full}BD) - {half}BD as long)")


def native_int16(payload: Column, byteswap: bool = True) -> Column:
    """ARRAY<INT> of all 16-bit integers of payload; each is cut out of the bytes, whose places are known."""

    def at(k: Column) -> Column:
        pair = F.substring(payload, k * 2 + 1, F.lit(2))
        text = F.hex(pair)
        text = text if byteswap else F.concat(F.substring(text, 3, 2), F.substring(text, 1, 2))
        return signed(F.conv(text, 16, 10).cast("int"), 16)

    n = F.floor(F.length(payload) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<int>"))
