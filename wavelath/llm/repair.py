"""Token-id files compressed by a grammar of id pairs (Re-Pair), per shard.

A shard holds the ids of documents in ascending key order. Frequent neighbouring
pairs become new symbols, the most frequent first, until no pair is left that occurs
LEAST times. A round takes all pairs that occur at least a STEEP-th as often as the most frequent one,
each at those places where neither neighbouring pair is more frequent, so that
no two places overlap and the most frequent pair is replaced wherever it stands. A pair of one
symbol twice is taken at alternate places of each run. A
pair never reaches over the end of a document, so every document owns a run of
symbols and is decoded alone. Rules and the lengths they expand to are stored.

Very long texts: a shard of their own size. Repeated rows: stored each. No rows: no shards. Columns beside key and text aren't read.

File format, little-endian: magic RPZ2; uint32 documents, rules, base (the first
symbol that is a rule), bits per symbol; uint64 symbols; then per document
uint8 key given, int64 key, int64 tokens, int64 symbols; per rule uint32 left,
right, expansion length; then the symbols, bit by bit: bit 0 of all, bit 1 of all ...
A shard is one row (binary) of a
Parquet table, so any file system that Spark writes to can hold it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, with_default
from .tokens import encoder

HEAD = struct.Struct("<4s4IQ")
MAGIC = b"RPZ2"
SHARD_SCHEMA = "part long, shard long, n_docs long, n_tokens long, n_symbols long, payload binary"
DOC_SCHEMA = "part long, shard long, doc_id long, local long, n_tokens long, ids_crc32 long"
#: Ids of a shard, before compression; a document is never parted.
SHARD_IDS = 1 << 22
#: Bits of the table that pairs are counted in.
BUCKETS = 21
#: A pair that occurs less often is not replaced.
LEAST = 16
STEEP = 100


def alternate(same: np.ndarray) -> np.ndarray:
    """Of ascending places, every second one of each run of places side by side."""
    heads = np.r_[True, np.diff(same) > 1]
    place = np.arange(len(same))
    return same[(place - np.maximum.accumulate(np.where(heads, place, 0))) % 2 == 1]


def sifted(bucket: np.ndarray, bits: int, least: int, steep: int) -> tuple[np.ndarray, np.ndarray]:
    """Of places, given their pairs' places in the table: which are rare, and the numbers of those that a round may replace.

    What a place of the table counts bounds its pairs' counts, so all others needn't be told apart in this round.
    """
    most = np.bincount(bucket, minlength=1 << bits)
    return (most < least)[bucket], np.flatnonzero((most >= max(least, int(most.max()) // steep))[bucket])


def compress(ids: np.ndarray, ends: np.ndarray, base: int, least: int = LEAST, steep: int = STEEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """symbols, their document-end flags, and rules (left, right), of ids whose ends are flagged.

    Counts of old pairs only fall, and pairs with a new symbol all arise in the round that makes it. So a place
    whose pair was found to be rare is not looked at again until one of its two symbols is replaced.
    """
    sym, end = ids.astype(np.uint32), ends.astype(bool)
    rules: list[np.ndarray] = []
    made, odd = base, np.random.default_rng(1)
    open_ = ~end
    while True:
        open_[-1:] = False
        at = np.flatnonzero(open_)
        left, right = sym[at], sym[at + 1]
        if (same := left == right).any():
            skip = np.zeros(len(sym), bool)
            skip[alternate(at[same])] = True
            count = ~skip[at]
            at, left, right = at[count], left[count], right[count]
        if not len(at):
            break
        bits = min(BUCKETS, len(at).bit_length() + 1)
        code = left.astype(np.uint64) << np.uint64(32) | right
        # Another multiplier each round: pairs that share a place of the table now won't share it again.
        bucket = (code * np.uint64(int(odd.integers(1, 1 << 62)) * 2 + 1) >> np.uint64(64 - bits)).view(np.int64)
        rare, may = sifted(bucket, bits, least, steep)
        open_[at[rare]] = False
        del left, right
        at, code, bucket = at[may], code[may], bucket[may]
        # A place of the table stands for the last pair written there; others that fall into it wait.
        pair_of = np.zeros(1 << bits, np.uint64)
        pair_of[bucket] = code
        mine = pair_of[bucket] == code
        del code
        at, bucket = at[mine], bucket[mine]
        seen = np.bincount(bucket, minlength=1 << bits)
        top = int(seen.max())
        count = seen[bucket]
        open_[at[count < least]] = False
        if top < least:
            continue
        often = count >= max(least, top // steep)
        at, bucket, count = at[often], bucket[often], count[often]
        # A pair's standing: its count, then its place in the table. The highest of neighbours is replaced.
        standing = np.zeros(len(sym) + 2, np.int64)
        own = count << bits | bucket
        standing[at + 1] = own
        stay = (own > standing[at]) & (own > standing[at + 2])
        at, bucket = at[stay], bucket[stay]
        enough = np.bincount(bucket, minlength=1 << bits) >= least
        stay = enough[bucket]
        at, bucket = at[stay], bucket[stay]
        taken = np.flatnonzero(enough)
        number = np.zeros(1 << bits, np.uint32)
        number[taken] = np.arange(made, made + len(taken), dtype=np.uint32)
        sym[at] = number[bucket]
        end[at] = end[at + 1]
        open_[at] = ~end[at]
        before = np.maximum(at - 1, 0)
        open_[before] = ~end[before]
        stay = np.ones(len(sym), bool)
        stay[at + 1] = False
        sym, end, open_ = sym[stay], end[stay], open_[stay]
        p = pair_of[taken]
        rules.append(np.stack([(p >> np.uint64(32)).astype(np.uint32), (p & np.uint64(0xFFFFFFFF)).astype(np.uint32)], 1))
        made += len(taken)
    return sym, end, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    out = np.ones(len(rules), np.uint32)
    length = lambda s: int(out[s - base]) if s >= base else 1
    for k, (a, b) in enumerate(rules.tolist()):
        out[k] = length(a) + length(b)
    return out


def expand(sym: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that sym stands for."""
    while len(big := np.flatnonzero(sym >= base)):
        wide = np.ones(len(sym), np.int64)
        wide[big] = 2
        place = np.cumsum(wide) - wide
        out = np.empty(int(wide.sum()), np.uint32)
        out[place] = sym
        pair = rules[sym[big] - base]
        out[place[big]], out[place[big] + 1] = pair[:, 0], pair[:, 1]
        sym = out
    return sym


def write_shard(keys: list, ids: list[np.ndarray], base: int) -> tuple[bytes, int]:
    """The bytes of a shard of documents, none of them without ids, and its number of symbols."""
    sizes = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate(ids)
    ends = np.zeros(len(flat), bool)
    ends[np.cumsum(sizes) - 1] = True
    sym, end, rules = compress(flat, ends, base)
    runs = np.diff(np.r_[0, np.flatnonzero(end) + 1]).astype("<i8")
    width = max(1, (base + len(rules) - 1).bit_length())
    given = np.array([k is not None for k in keys], np.uint8)
    head = HEAD.pack(MAGIC, len(keys), len(rules), base, width, len(sym))
    parts = [given, np.array([k or 0 for k in keys], "<i8"), sizes.astype("<i8"), runs, rules[:, 0].astype("<u4"), rules[:, 1].astype("<u4"), expansion_lengths(rules, base).astype("<u4"), *(np.packbits((sym >> np.uint32(k) & np.uint32(1)).astype(np.uint8)) for k in range(width))]
    return head + b"".join(p.tobytes() for p in parts), len(sym)


class Shard:
    """A written shard: decodes all of it, or a range of one document's ids."""

    def __init__(self, payload: bytes):
        magic, docs, rules, self.base, width, symbols = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        given, keys = take("u1", docs), take("<i8", docs)
        self.keys = [int(k) if g else None for g, k in zip(given, keys, strict=True)]
        self.sizes, self.runs = take("<i8", docs), take("<i8", docs)
        self.rules = np.stack([take("<u4", rules), take("<u4", rules)], 1)
        self.lengths = take("<u4", rules)
        self.symbols = np.zeros(symbols, np.uint32)
        for k in range(width):
            self.symbols |= np.unpackbits(take("u1", -(-symbols // 8)), count=symbols).astype(np.uint32) << np.uint32(k)

    def ids(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.base)

    def read(self, doc: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of the doc-th document, expanding only the symbols that hold them."""
        first = int(self.runs[:doc].sum())
        sym = self.symbols[first : first + int(self.runs[doc])]
        stop = min(int(self.sizes[doc]), int(self.sizes[doc]) if stop is None else stop)
        wide = np.where(sym >= self.base, self.lengths[np.maximum(sym, self.base) - self.base] if len(self.lengths) else 1, 1)
        after = np.cumsum(wide)
        lo, hi = np.searchsorted(after, start, "right"), np.searchsorted(after, stop, "left") + 1
        skip = int(after[lo - 1]) if lo else 0
        return expand(sym[lo:hi], self.rules, self.base)[start - skip : stop - skip]


def encode_shards(docs: DataFrame, path: str, end_id: int = 2, base: int = 49408, shard_ids: int = SHARD_IDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Shards of all docs in ascending key order: (part, shard) is their order.

    base must exceed every id. null key: first. null or empty text: the end id
    alone. Repeated keys: side by side, ordered by a hash of their texts.
    """
    small_batches(docs.sparkSession)
    rows = docs.selectExpr(f"cast(`{key}` as long) as doc_id", f"`{text}` as text").withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches):
        enc, part, shard = encoder(path, words=True), TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint32)
        keys: list = []
        ids: list[np.ndarray] = []
        held = 0

        def flush():
            payload, symbols = write_shard(keys, ids, base)
            row = [part, shard, len(keys), held, symbols, payload]
            kinds = [pa.int64()] * 5 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["part", "shard", "n_docs", "n_tokens", "n_symbols", "payload"])

        for b in batches:
            for k, x in zip(b.column("doc_id").to_pylist(), enc.ids(with_default(b, "text")), strict=True):
                keys.append(k)
                ids.append(np.concatenate([x, end]))
                held += len(x) + 1
                if held >= shard_ids:
                    yield flush()
                    keys, ids, held, shard = [], [], 0, shard + 1
        if keys:
            yield flush()

    return rows.select("doc_id", "text").mapInArrow(run, SHARD_SCHEMA)


def decode_shards(shards: DataFrame) -> DataFrame:
    """Per document of written shards: part, shard, doc_id, ids before it in the shard, tokens, crc32 of its ids."""

    def run(batches):
        for b in batches:
            for part, shard, payload in zip(b.column("part").to_pylist(), b.column("shard").to_pylist(), b.column("payload"), strict=True):
                s = Shard(payload.as_py())
                ids = s.ids().astype("<u4")
                after = np.cumsum(s.sizes)
                before = after - s.sizes
                crc = [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(before.tolist(), after.tolist(), strict=True)]
                n = len(s.keys)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([part] * n, [shard] * n, s.keys, before, s.sizes, crc)], ["part", "shard", "doc_id", "local", "n_tokens", "ids_crc32"])

    return shards.select("part", "shard", "payload").mapInArrow(run, DOC_SCHEMA)


def documents(shards: DataFrame) -> DataFrame:
    """decode_shards with start, the ids of all documents before: one row per shard of millions of ids is summed up, not one per document."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = shards.select("part", "shard", "n_tokens").withColumn("before", before).drop("n_tokens")
    return decode_shards(shards).join(offsets, ["part", "shard"]).selectExpr("doc_id", "before + local as start", "n_tokens", "ids_crc32")
