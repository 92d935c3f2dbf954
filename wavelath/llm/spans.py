"""Spans of bytes, hashed and looked up many at once in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Bytes hashed at once.
SPAN = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_TABLES: list[np.ndarray] = []
#: Class of each byte: 0 white space of ASCII, 1 part of a word, 2 between texts (0xFF is in no UTF-8 text).
BETWEEN = 0xFF
CLASS = np.ones(256, np.int8)
CLASS[[9, 10, 11, 12, 13, 32]] = 0
CLASS[BETWEEN] = 2


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(_ODD)
    return x ^ (x >> np.uint64(29))


def tables() -> list[np.ndarray]:
    """Random words for bytes, powers of an odd number, and of its inverse modulo 2**64."""
    if not _TABLES:
        steps = [np.full(SPAN + 1, c, np.uint64) for c in (_ODD, pow(_ODD, -1, 1 << 64))]
        for x in steps:
            x[0] = 1
        _TABLES.extend([np.random.default_rng(3).integers(1, 1 << 63, 256, np.uint64), *(np.multiply.accumulate(x) for x in steps)])
    return _TABLES


def hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of raw (at most SPAN bytes): byte values times powers, summed, made free of the place."""
    value, power, inverse = tables()
    x = value[raw]
    x *= power[: len(raw)]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(x, out=sums[1:])
    return mix((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of True."""
    flags = np.zeros(len(mask) + 2, np.int8)
    flags[1:-1] = mask
    edge = np.flatnonzero(flags[1:] != flags[:-1])
    return edge[::2], edge[1::2]


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return runs(CLASS[raw] == 1)


def pieces(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, each with one space before it, and what white space is left, cut as byte-level pre-tokenizers do.

    Of white space before a word the last character stands alone, unless it is
    the space that goes with the word; white space at a text's end stays whole.
    """
    kind = CLASS[raw]
    start, stop = runs(kind == 1)
    lead = start > 0
    lead[lead] = raw[start[lead] - 1] == 32
    a, b = runs(kind == 0)
    word_next = np.zeros(len(b), bool)
    inside = b < len(raw)
    word_next[inside] = kind[b[inside]] == 1
    rest = b - word_next
    alone = word_next & (raw[b - 1] != 32)
    begin = np.concatenate([start - lead, a[rest > a], b[alone] - 1])
    end = np.concatenate([stop, rest[rest > a], b[alone]])
    order = np.argsort(begin, kind="stable")
    return begin[order], end[order]


class Table:
    """Numbers of spans by hash, in open addressing; learn(spans as bytes) is told of new ones, in order of their numbers."""

    def __init__(self, learn: Callable[[list[bytes]], None], forget: Callable[[], None], bits: int = 22):
        self.learn, self.forget, self.bits = learn, forget, bits
        self.clear()

    def clear(self) -> None:
        self.keys, self.number, self.n = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32), 0
        self.forget()

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash, -1 where it is new."""
        out = np.full(len(h), -1, np.int64)
        slot, left = self._slot(h), np.arange(len(h))
        while len(left):
            key = self.keys[slot]
            hit = key == h[left]
            out[left[hit]] = self.number[slot[hit]]
            on = ~hit & (key != 0)
            left, slot = left[on], slot[on] + 1 & (1 << self.bits) - 1
        return out

    def add(self, h: np.ndarray) -> None:
        """Numbers new distinct hashes in order."""
        number = np.arange(self.n, self.n + len(h))
        self.n += len(h)
        slot = self._slot(h)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            mine = self.keys[slot] == h
            self.number[slot[mine]] = number[mine]
            h, number, slot = h[~mine], number[~mine], slot[~mine] + 1 & (1 << self.bits) - 1

    def numbers(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Number of each span of raw."""
        if not len(start):
            return np.zeros(0, np.int64)
        h = np.maximum(hashes(raw, start, stop), np.uint64(1))
        found = self.find(h)
        miss = np.flatnonzero(found < 0)
        if len(miss):
            if self.n + len(miss) > (1 << self.bits) * 6 // 10:
                self.clear()
                miss = np.arange(len(h))
            new, first = np.unique(h[miss], return_index=True)
            at = miss[first]
            text = raw.tobytes()
            self.learn([text[i:j] for i, j in zip(start[at].tolist(), stop[at].tolist(), strict=True)])
            self.add(new)
            found[miss] = self.find(h[miss])
        return found


def grouped(raws: list[bytes], size: int = SPAN) -> list[list[int]]:
    """Numbers of texts, in order, in groups that joined take at most size bytes; a longer text is a group of its own."""
    out: list[list[int]] = []
    room = 0
    for k, raw in enumerate(raws):
        if len(raw) + 1 > room or not out:
            out.append([])
            room = size
        out[-1].append(k)
        room -= len(raw) + 1
    return out


def joined(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with BETWEEN after each, and the ends of the texts."""
    raw = np.frombuffer(b"\xff".join([*raws, b""]), np.uint8)
    return raw, np.cumsum([len(r) + 1 for r in raws])
