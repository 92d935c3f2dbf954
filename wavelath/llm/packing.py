"""Harmonic packing of token sequences.

A document's ids and its end id are cut into full sequences; of the rest, as long as at least TAIL ids are left, the greatest
part of a sequence (a half, third, quarter ...) that it holds is cut off, unless the rest as it is wastes at most WASTE ids of a sequence; what is left
stays one piece. A piece of length n is of class j = capacity // n, so that j
pieces of its class fill a sequence: every worker fills sequences of each class
with exactly j pieces, without a word to other workers. Parts fill
theirs but for fewer than j ids. The pieces in a worker's unfilled sequences, fewer than j
per class, are laid end to end at last, cut at the capacity, and the rest is cut
at powers of two, which take no padding.

null text: empty, so the end id alone. Very long texts: more pieces. Repeated
rows: packed each. No rows: no pieces. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import small_batches, with_default
from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
TAIL, WASTE = 128, 16
#: Sequences of one worker; sequence_id is the worker's number times this, plus a count.
STRIDE = 1 << 40


def cuts(n: int, capacity: int, tail: int = TAIL) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest >= tail and capacity - capacity // rest * rest > WASTE:
        out.append(capacity // -(-capacity // rest))
        rest -= out[-1]
    return out + [rest] * (rest > 0)


class Bins:
    """One worker's open sequences; gives pieces (doc_id, start, ids, doc_tokens, sequence_id, offset)."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.open: dict[int, list[tuple]] = {}

    def close(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, ids, total, self.next, at
            at += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        at = 0
        for n in cuts(len(ids), self.capacity):
            j = self.capacity // n
            bin_ = self.open.setdefault(j, [])
            bin_.append((doc, at, ids[at : at + n].copy() if n < len(ids) else ids, len(ids)))  # a view would keep all of a long document
            at += n
            if len(bin_) == j:
                yield from self.close(self.open.pop(j))

    def rest(self) -> Iterator[tuple]:
        """What no class filled: end to end, cut at the capacity, the last ids at powers of two."""
        left = [p for j in sorted(self.open) for p in self.open[j]]
        self.open = {}
        total = sum(len(p[2]) for p in left)
        sizes = [self.capacity] * (total // self.capacity)
        total %= self.capacity
        sizes += [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
        k, used = 0, 0
        for size in sizes:
            sequence, room = [], size
            while room:
                doc, start, ids, tokens = left[k]
                part = ids[used : used + room]
                sequence.append((doc, start + used, part, tokens))
                room -= len(part)
                used += len(part)
                if used == len(ids):
                    k, used = k + 1, 0
            yield from self.close(sequence)


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Pieces of all docs in sequences of capacity ids (a power of two); with_ids adds the ids themselves."""
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("capacity must be a power of two")
    small_batches(docs.sparkSession)

    def batch(pieces: list[tuple]) -> pa.RecordBatch:
        doc, start, ids, tokens, sequence, offset = zip(*pieces, strict=True)
        cols = [doc, start, [len(x) for x in ids], [zlib.crc32(x.astype("<u4").tobytes()) for x in ids], tokens, sequence, offset]
        arrays, names = [pa.array(c, pa.int64()) for c in cols], NAMES
        if with_ids:
            arrays, names = [*arrays, pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches):
        enc = encoder(path)
        bins = Bins(capacity, TaskContext.get().partitionId() * STRIDE)
        end = np.array([end_id], np.uint32)
        for b in batches:
            out: list[tuple] = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), enc.ids(with_default(b, "text")), strict=True):
                out += bins.add(doc, np.concatenate([ids, end]))
            if out:
                yield batch(out)
        if out := list(bins.rest()):
            yield batch(out)

    return docs.selectExpr(f"cast(`{key}` as long) as doc_id", f"`{text}` as text").mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
