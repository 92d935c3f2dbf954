"""Near-duplicate texts by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five words in a row (a text of one to four words is one shingle). Its
weight is its count in the text times a smoothed inverse document frequency,
ln(1 / (share * THETA)), share being its part of all documents, THETA at least; given
as a factor from 1 (share up to THETA) to 0.5 (every document). So exact document
frequencies, over all documents, are needed only for shingles over THETA, of which there are at most (mean
shingles of a document) / THETA, however many documents there are. They are found in
two passes: each task's frequent shingles with a bound for those it leaves out,
then exact counts of what may exceed THETA.

Each text gets SAMPLES consistent weighted samples, cut into BANDS. All texts that
agree in a band are verified by weighted Jaccard over whole texts, which alone
decides: each with the band's first text and, if they don't link, with those read beside it; and then those outside the band's
largest component with all others, in tiles of bounded size that give only a
spanning forest of the links. Bands of the same texts are verified once. No cap leaves
a pair out; what is lost are pairs that share no band.

Equal texts are one class from the start, by a 128-bit digest; texts, not keys, are
what is linked, so rows of one key with other texts don't matter. null text: empty.
Texts without words: a class with equal texts alone. null key: class null, kept.
Repeated rows: same class. Very long texts: hashed in parts, in tiles of their own. No rows: no rows. Only
the key and text are read; other columns pass through dedup(), inner names start with two underscores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, dealt, small_batches, staged, with_default
from .spans import SPAN, hashes, joined, mix, words
from .spans import grouped as grouped_texts

SHINGLE = 5
THRESHOLD = 0.8
SAMPLES, BANDS = 48, 16
ROWS = SAMPLES // BANDS
#: Share of documents from which a shingle weighs less.
THETA = 0.001
#: Bytes of small tasks that are read together at most.
TASK_BYTES = 1 << 28
#: Shingles that a task counts at once.
SEGMENT = 1 << 22
#: Texts of one side of a tile, and their bytes, as means.
TEXTS, BYTES = 200, 1 << 24
#: Members of a group verified in one place against its first text.
PART = 128


def hashed(raws: list[bytes]) -> list[np.ndarray]:
    """Word hashes of each text; texts are hashed together up to SPAN bytes, longer ones in parts that end at a space."""
    out: list[np.ndarray] = []
    for group in grouped_texts(raws):
        if len(raws[group[0]]) >= SPAN:
            raw, parts = raws[group[0]], []
            while raw:
                stop = len(raw) if len(raw) < SPAN else max(raw.rfind(c, 0, SPAN - 1) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) + 1 or SPAN - 1
                part = np.frombuffer(raw[:stop], np.uint8)
                parts.append(hashes(part, *words(part)))
                raw = raw[stop:]
            out.append(np.concatenate(parts))
            continue
        raw, ends = joined([raws[k] for k in group])
        start, stop = words(raw)
        w, cut = hashes(raw, start, stop), np.searchsorted(start, ends)
        out += [w[i:j] for i, j in zip([0, *cut[:-1]], cut, strict=True)]
    return out


def shingles(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct shingles, as ascending 64-bit hashes, and their counts."""
    out = []
    for w in hashed([t.encode("utf-8", "surrogatepass") for t in texts]):
        n = min(SHINGLE, len(w))
        h = np.zeros(len(w) - n + 1 if n else 0, np.uint64)
        for k in range(n):
            h *= np.uint64(0xD6E8FEB86659FD93)
            h += w[k : len(w) - n + 1 + k]
        h = mix(h)
        h.sort()
        new = np.empty(len(h), bool)
        new[:1] = True
        np.not_equal(h[1:], h[:-1], out=new[1:])
        if new.all():
            out.append((h, np.ones(len(h), np.int64)))
        else:
            heads = np.flatnonzero(new)
            out.append((h[heads], np.diff(np.append(heads, len(h)))))
    return out


class Idf:
    """The factor of shingles: 1, or less for the frequent ones it holds."""

    def __init__(self, n_docs: int = 0, hashes: np.ndarray | None = None, df: np.ndarray | None = None):
        order = np.argsort(hashes) if hashes is not None else np.zeros(0, np.int64)
        self.hashes = hashes[order] if hashes is not None else np.zeros(0, np.uint64)
        self.factor = 0.5 + 0.5 * np.log(n_docs / df[order]) / np.log(1 / THETA) if len(order) else np.zeros(0)
        self.index = Index(self.hashes)

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h))
        at, found = self.index.find(h)
        out[at] = self.factor[found]
        return out


class Index:
    """Places of hashes in an ascending array of them; a table of leading bits turns most others away."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bits = np.uint64(64 - min(24, max(8, 4 + len(hashes).bit_length())))
        self.may = np.zeros(1 << (64 - int(self.bits)), bool)
        self.may[hashes >> self.bits] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of h are held, and where."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.may[h >> self.bits])
        where = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        same = self.hashes[where] == h[at]
        return at[same], where[same]


def _signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def frequencies(docs: DataFrame) -> Idf:
    """The document frequencies over THETA, counted over all rows (text)."""
    spark = docs.sparkSession
    small_batches(spark)
    # A task of few documents can leave nothing out; so many small ones are read together that each has about 4 / THETA,
    # but no more than TASK_BYTES, by the size that the plan is reckoned to have.
    rows = docs.select("text")
    tasks = 1 + max(int(docs.count() * THETA / 4), int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // TASK_BYTES)
    rows = rows.coalesce(tasks) if rows.rdd.getNumPartitions() > tasks else rows

    def heavy(batches):
        held: list[np.ndarray] = []
        spare: list[np.ndarray] = []
        size = 0

        def counted(part: list[np.ndarray]):
            values, counts = np.unique(np.concatenate(part), return_counts=True)
            n, size = len(part), sum(map(len, part))
            keep = counts > int(n * THETA / 2)
            values, counts = values[keep], counts[keep]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.r_[_signed(values), 0], np.r_[counts, 0], np.r_[np.full(len(values), n), n], np.r_[np.full(len(values), int(n * THETA / 2)), -1 - int(n * THETA / 2)], np.r_[np.zeros(len(values), int), size])], ["h", "n", "docs", "left", "size"])

        for b in batches:
            own = [h for h, _ in shingles(with_default(b, "text"))]
            # A segment is counted when as much again is held, so that the last one isn't small: small ones say little.
            if size >= SEGMENT:
                spare.extend(held)
                held, size = [], 0
                if sum(map(len, spare)) >= 2 * SEGMENT:
                    half = len(spare) // 2
                    yield from counted(spare[:half])
                    spare = spare[half:]
            held += own
            size += sum(map(len, own))
        if spare or held:
            yield from counted(spare + held)

    seen = staged(rows.mapInArrow(heavy, "h long, n long, docs long, left long, size long"), "heavy")
    # The row of a segment as a whole has left below 0: -1 less the most it may hold of a shingle it leaves out.
    total = seen.where("left < 0").agg(F.sum("docs"), F.sum("size"), F.sum(-1 - F.col("left"))).first()
    n_docs, n_shingles, n_left = (x or 0 for x in total)
    if not n_docs:
        return Idf()
    sums = seen.where("left >= 0").groupBy("h").agg(F.sum("n").alias("n"), F.sum("left").alias("left"))
    may = sums.where(F.col("n") + n_left - F.col("left") > THETA * n_docs)
    # All segments together leave out at most half of THETA, so such a shingle was counted over THETA / 2.
    bound = int(n_shingles / n_docs / (THETA / 2)) + 1
    found = np.sort(_column(may.select("h").limit(bound + 1), "h").view(np.uint64))
    if len(found) > bound:
        raise AssertionError("more frequent shingles than there can be")
    if not len(found):
        return Idf()
    shared = spark.sparkContext.broadcast(found)

    def exact(batches):
        index = Index(shared.value)
        counts = np.zeros(len(shared.value), np.int64)
        for b in batches:
            for h, _ in shingles(with_default(b, "text")):
                counts[index.find(h)[1]] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(_signed(shared.value[at]), pa.int64()), pa.array(counts[at], pa.int64())], ["h", "n"])

    counts = rows.mapInArrow(exact, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > THETA * n_docs).toArrow()
    return Idf(n_docs, counts.column("h").to_numpy().view(np.uint64), counts.column("n").to_numpy())


def _column(rows: DataFrame, name: str) -> np.ndarray:
    return rows.toArrow().column(name).to_numpy().copy()


class Sampler:
    """Improved consistent weighted samples: least ln a over a text's shingles, with r, c of Gamma(2, 1) and b uniform.

    a of a shingle of weight 1 is exponential; it is drawn first, from a hash of
    shingle and sample, and c, r and b are drawn given it: c = a + e, with -ln(a / c) =
    r (1 - b) = x, and r = x + e', e and e' exponential. So where the weight is 1 the order of a
    is the order of the hash, and only other weights need the rest.
    """

    def __init__(self):
        seeds = np.random.default_rng(5)
        self.salt = seeds.integers(1, 1 << 63, SAMPLES, np.uint64)
        self.odd = seeds.integers(1, 1 << 63, SAMPLES, np.uint64) | np.uint64(1)

    @staticmethod
    def reweighed(x: np.ndarray, ln_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order (32 bits) and step t of samples with hash x and weight exp(ln_w)."""
        unit = lambda v, bits: ((v & np.uint64((1 << bits) - 1)).astype(np.float64) + 0.5) / (1 << bits)
        more = mix(x)
        a = -np.log1p(-unit(x >> np.uint64(32), 32))
        c = a - np.log(unit(more, 32))
        part = np.log(c / a)
        r = part - np.log(unit(more >> np.uint64(32), 32))
        b = 1 - part / r
        t = np.floor(ln_w / r + b)
        ln_a = np.log(c) - r * (t - b) - r
        return (-np.expm1(-np.exp(ln_a)) * (1 << 32)).astype(np.uint64), t.astype(np.int64)

    def block(self, h: np.ndarray, ln_w: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Samples (as 32-bit names) of the texts that start at heads: len(heads) x SAMPLES."""
        low, high = np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000)
        name = h & low
        other = np.flatnonzero(ln_w)
        out = np.empty((len(heads), SAMPLES), np.uint32)
        x, y = np.empty_like(h), np.empty_like(h)
        for k in range(SAMPLES):
            np.bitwise_xor(h, self.salt[k], out=x)
            x *= self.odd[k]
            np.right_shift(x, np.uint64(32), out=y)
            x ^= y
            x *= np.uint64(0xBF58476D1CE4E5B9)
            np.bitwise_and(x, high, out=y)
            y |= name
            if len(other):
                order, t = self.reweighed(x[other], ln_w[other])
                y[other] = np.minimum(order, low) << np.uint64(32) | (name[other] + t.astype(np.uint64) * np.uint64(0x9E3779B1)) & low
            # The order stands before the name, so that one minimum finds both.
            out[:, k] = np.minimum.reduceat(y, heads) & low
        return out

    def signatures(self, texts: list[tuple[np.ndarray, np.ndarray]], idf: Idf, width: int = 1 << 15) -> list[np.ndarray | None]:
        """Samples of each text; None without shingles."""
        out: list[np.ndarray | None] = [None] * len(texts)
        group: list[int] = []
        size = 0
        full = [k for k, (h, _) in enumerate(texts) if len(h)]
        for k in full:
            group.append(k)
            size += len(texts[k][0])
            if size >= width or k == full[-1]:
                h = np.concatenate([texts[g][0] for g in group])
                n = np.concatenate([texts[g][1] for g in group])
                heads = np.cumsum([0, *(len(texts[g][0]) for g in group[:-1])])
                ln_w = np.log(n * idf.of(h))
                for g, s in zip(group, self.block(h, ln_w, heads), strict=True):
                    out[g] = s
                group, size = [], 0
        return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    x = np.zeros(BANDS, np.uint64)
    for k in range(ROWS):
        x = mix(x * np.uint64(0xD6E8FEB86659FD93) + signature[k::ROWS])
    return _signed(mix(x + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)))


def weights(text: tuple[np.ndarray, np.ndarray], idf: Idf) -> np.ndarray:
    return text[1] * idf.of(text[0])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], idf: Idf) -> float:
    """Weighted Jaccard of two texts' shingles."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    wa, wb = weights(a, idf), weights(b, idf)
    common = np.minimum(wa[same], wb[at[same]]).sum()
    return float(common / (wa.sum() + wb.sum() - common))


def digested(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __t1 and __t2, which name a text by 128 bits; null is the empty text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("__t1", F.xxhash64(t)).withColumn("__t2", F.xxhash64(F.lit(1), t))


def signed_texts(docs: DataFrame, idf) -> DataFrame:
    """doc_id, __t1, __t2, size (bytes) and bands of every row; idf is a broadcast."""

    def run(batches):
        sampler = Sampler()
        for b in batches:
            texts = with_default(b, "text")
            sigs = sampler.signatures(shingles(texts), idf.value)
            bands = [None if s is None else band_keys(s) for s in sigs]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "__t1", "__t2")), pa.array([4 * len(t) for t in texts], pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "__t1", "__t2", "size", "bands"])

    return docs.select("doc_id", "__t1", "__t2", "text").mapInArrow(run, "doc_id long, __t1 long, __t2 long, size long, bands array<long>")


def grouped(batches, keys: list[str], columns: list[str]) -> Iterator[dict[str, list]]:
    """Groups of rows sorted by keys, as lists by column."""
    held: dict[str, list] = {}
    now = None
    for b in batches:
        cols = {c: b.column(c).to_pylist() for c in {*keys, *columns}}
        ids = list(zip(*(cols[k] for k in keys), strict=True))
        at = 0
        while at < len(ids):
            stop = at
            while stop < len(ids) and ids[stop] == ids[at]:
                stop += 1
            if ids[at] != now:
                if held:
                    yield held
                held, now = {c: [] for c in columns}, ids[at]
            for c in columns:
                held[c] += cols[c][at:stop]
            at = stop
    if held:
        yield held


class Sets:
    """Union-find over the places 0 to n - 1."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.root[max(x, y)] = min(x, y)
        return x != y


def tiled(members: DataFrame, size: int, width: int = BYTES) -> DataFrame:
    """Tiles for groups with texts of more than one part: those outside the group's largest part against all.

    members: grp, v, size, comp. Rows out: grp, p, q, left, right (whether a row is
    of the tile's left or right side), v, comp. A side holds about size rows, or width bytes.
    """
    parts = members.groupBy("grp", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    main = parts.groupBy("grp").agg(F.max(F.struct("n", "comp", "bytes")).alias("m"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("k")).where("k > 1")
    side = lambda n, b: f"cast(ceil(greatest({n} / {size}, {b} / {width})) as int)"
    main = dealt(main.selectExpr("grp", "m.comp as main", f"{side('n', 'bytes')} as ps", f"{side('(n - m.n)', '(bytes - m.bytes)')} as qs"))
    rows = members.join(main, "grp").withColumn("p", F.pmod(F.xxhash64("v"), F.col("ps")).cast("int")).withColumn("q", F.pmod(F.xxhash64("v", F.lit(1)), F.col("qs")).cast("int"))
    outside = F.col("comp") != F.col("main")
    right = F.transform(F.expr("sequence(0, qs - 1)"), lambda q: F.struct(F.col("p").alias("p"), q.alias("q"), (outside & (q == F.col("q"))).alias("left"), F.lit(True).alias("right")))
    left = F.filter(F.transform(F.expr("sequence(0, ps - 1)"), lambda p: F.struct(p.alias("p"), F.col("q").alias("q"), F.lit(True).alias("left"), F.lit(False).alias("right"))), lambda t: t["p"] != F.col("p"))
    none = F.array().cast("array<struct<p:int,q:int,left:boolean,right:boolean>>")
    return rows.withColumn("t", F.explode(F.concat(right, F.when(outside, left).otherwise(none)))).select("grp", "t.*", "v", "comp")


def exact(members: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """Spanning edges (a, b) between the components of a bucket's texts (grp, v, size, comp) that verified links join."""
    tiles = tiled(members, TEXTS).join(texts, "v").repartition("grp", "p", "q").sortWithinPartitions("grp", "p", "q", "v")

    def run(batches):
        for g in grouped(batches, ["grp", "p", "q"], ["left", "right", "comp", "text"]):
            out = links_in(g, idf.value)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return tiles.mapInArrow(run, "a long, b long")


def links_in(g: dict[str, list], idf: Idf) -> list[tuple[int, int]]:
    """Edges between components of the links between the left and the right rows of a tile.

    Only shingles that two of the tile's texts hold can be common to a pair: each left text meets, through
    the places of its shingles, just those texts that share some with it, and the sums over them are exact.
    """
    return linked(shingles([t or "" for t in g["text"]]), g["comp"], g["left"], g["right"], idf)


def linked(own: list[tuple[np.ndarray, np.ndarray]], comp: list[int], left: list[bool], right: list[bool], idf: Idf) -> list[tuple[int, int]]:
    """links_in, given the shingles of the tile's texts, none of them without any."""
    left, right = np.flatnonzero(left), np.array(right, bool)
    sets, first, out = Sets(len(comp)), {}, []
    for k, c in enumerate(comp):
        sets.join(first.setdefault(c, k), k)
    size = np.array([len(h) for h, _ in own])
    start = np.cumsum(size) - size
    h, number = np.unique(np.concatenate([h for h, _ in own]), return_inverse=True)
    weight = np.concatenate([n for _, n in own]) * idf.of(h)[number]
    total = np.add.reduceat(weight, start)
    # The holders of each shingle, shingle after shingle.
    holders = np.bincount(number, minlength=len(h))
    order = np.argsort(number, kind="stable")
    owner, held = np.repeat(np.arange(len(comp)), size)[order], weight[order]
    begin = np.cumsum(holders) - holders
    for i in left.tolist():
        mine = slice(start[i], start[i] + size[i])
        few = holders[number[mine]] > 1
        num, w = number[mine][few], weight[mine][few]
        n = holders[num]
        at = np.arange(n.sum()) + np.repeat(begin[num] - (np.cumsum(n) - n), n)
        common = np.bincount(owner[at], np.minimum(held[at], np.repeat(w, n)), len(comp))
        for j in np.flatnonzero(right & (common >= THRESHOLD * (total + total[i] - common))).tolist():
            if sets.join(i, j):
                out.append((comp[i], comp[j]))
    return out


def verified(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """Spanning edges (a, b) of the links among texts that meet by their pairs (a, b); texts: v, text, one row each.

    Pairs meet by their first text, PART of them in one place, each text of a place read once. There
    each text meets the first one, and those that it doesn't link to meet all others of the place: so where a group's
    texts mostly link, though not to its first one, few are left for tiles.
    """
    parts = dealt(pairs.groupBy("a").agg(F.ceil(F.count("*") / float(PART)).cast("int").alias("parts")))
    rows = pairs.join(parts, "a").selectExpr("a", "b as v", "cast(pmod(xxhash64(b), parts) as int) as part", "1 as kind")
    firsts = parts.select("a", F.col("a").alias("v"), F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.lit(0).alias("kind"))
    met = rows.unionByName(firsts).join(texts, "v").select("a", "part", "kind", "v", "text").repartition("a", "part").sortWithinPartitions("a", "part", "kind", "v")

    def run(batches):
        now, first, held, size = None, None, [], 0
        for b in batches:
            own = shingles(with_default(b, "text"))
            out = []
            for a, part, kind, v, s in zip(*(b.column(c).to_pylist() for c in ("a", "part", "kind", "v")), own, strict=True):
                # Long texts of a place are met in several lots, each with the first text.
                if now != (a, part) or size >= SEGMENT // 2:
                    out += links_of(first, held, idf.value)
                    held, size = [], 0
                if kind == 0:
                    now, first = (a, part), (v, s)
                elif now == (a, part):
                    held.append((v, s))
                    size += len(s[0])
            yield _edges(out)
        yield _edges(links_of(first, held, idf.value))

    return met.mapInArrow(run, "a long, b long")


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def links_of(first: tuple | None, others: list[tuple], idf: Idf) -> list[tuple[int, int]]:
    """Spanning edges of the links between the first text and others (each v, shingles), and of those it doesn't link to with all others."""
    near = [similarity(first[1], s, idf) >= THRESHOLD for _, s in others]
    out = [(first[0], v) for (v, _), yes in zip(others, near, strict=True) if yes]
    if len(others) > 1 and not all(near):
        comp = [first[0] if yes else v for (v, _), yes in zip(others, near, strict=True)]
        out += linked([s for _, s in others], comp, [not yes for yes in near], [True] * len(others), idf)
    return out


def classified(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, __t1, __t2 of each row of docs with a key, and class (doc_id, __t1, __t2): the least of its class."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = digested(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")))
    idf = spark.sparkContext.broadcast(frequencies(rows))
    signed = staged(signed_texts(rows, idf), "signed").where("doc_id is not null")
    # One vertex, v, for each text, numbered as they are written.
    reps = signed.groupBy("__t1", "__t2").agg(F.min(F.struct("doc_id", "size", "bands")).alias("m")).select("__t1", "__t2", "m.*")
    reps = staged(reps.withColumn("v", F.monotonically_increasing_id()), "reps")
    buckets = reps.where("bands is not null").select(F.explode("bands").alias("grp"), "v", "size")
    first = dealt(buckets.groupBy("grp").agg(F.min("v").alias("a"), F.count("*").alias("n")).where("n > 1").select("grp", "a"))
    shared = staged(buckets.join(first, "grp"), "buckets")
    # Only texts that share a band are read, at the cost of one shuffle. There may be too many for a broadcast, so none is tried.
    met = reps.join(shared.select("v").distinct(), "v", "left_semi").select("doc_id", "__t1", "__t2", "v").hint("merge")
    texts = staged(rows.join(met, ["doc_id", "__t1", "__t2"]).dropDuplicates(["doc_id", "__t1", "__t2"]).select("v", "text"), "texts")
    pairs = staged(shared.where("v <> a").select("a", F.col("v").alias("b")).distinct(), "pairs")
    near = components(verified(pairs, texts, idf)).withColumnRenamed("id", "v").withColumnRenamed("component", "comp")
    near = staged(near, "near")
    # The first text has met all others of its bucket: only those have to meet. Buckets of the same texts count once.
    others = shared.where("v <> a").select("grp", "v", "size")
    sets = others.groupBy("grp").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("v")).alias("x"), F.bit_xor(F.xxhash64("v", F.lit(1))).alias("y")).where("n > 1")
    sets = dealt(sets.groupBy("n", "x", "y").agg(F.min("grp").alias("grp")).select("grp"))
    part = lambda df: df.join(near, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
    sides = staged(part(others.join(sets, "grp")), "sides")
    last = dealt(components(exact(sides, texts, idf)).selectExpr("id as comp", "component as last"))
    known = part(reps.drop("bands")).join(last, "comp", "left").select("__t1", "__t2", "doc_id", F.coalesce("last", "comp").alias("comp"))
    known = staged(known, "known")
    least = dealt(known.groupBy("comp").agg(F.min(F.struct("doc_id", "__t1", "__t2")).alias("class")))
    known = staged(known.join(least, "comp").select("__t1", "__t2", "class"), "classes")
    return signed.select("doc_id", "__t1", "__t2").join(known, ["__t1", "__t2"])


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, class_id (the least doc_id of its group), kept, class_text of each row of docs.

    class_text names the class by its kept text, where one doc_id holds several texts and so may be the least of several classes.
    """
    mine = (F.col("doc_id") == F.col("class.doc_id")) & (F.col("__t1") == F.col("class.__t1")) & (F.col("__t2") == F.col("class.__t2"))
    name = F.concat(*(F.lpad(F.hex(F.col(f"class.{c}")), 16, "0") for c in ("__t1", "__t2")))
    out = classified(docs, text, key).select("doc_id", F.col("class.doc_id").alias("class_id"), mine.alias("kept"), name.alias("class_text"))
    none = docs.where(F.col(key).isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"), F.lit(None).cast("string").alias("class_text"))
    return out.unionByName(none)


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one row of each class: that of the least key and text. Rows without a key stay."""
    stay = classified(docs, text, key).select("class.*").distinct().withColumnRenamed("doc_id", "__key").hint("merge")
    rows = digested(docs, text).withColumn("__key", F.col(key).cast("long"))
    met = rows.join(stay, ["__key", "__t1", "__t2"], "left_semi").dropDuplicates(["__key", "__t1", "__t2"]).select(*docs.columns)
    return met.unionByName(docs.where(F.col(key).isNull()))
