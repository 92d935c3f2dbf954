"""Mixing sources to target weights, block by block, in built-in DataFrame functions.

The words of each source, documents in a pseudorandom order, are parted into
blocks of BLOCK words. The mix is a row of slots in shards of SHARD slots; each
shard draws multinomially how many of its slots every source gets: one draw for each
slot. What a source draws over its quota (its target in slots) through all
shards is handed, slot by slot, to the sources that drew under theirs, so that totals meet the targets.
A source's slots are numbered through all shards, and slot i takes the
block that an affine permutation of the source's blocks, another one for each pass
over them, has at i. Slots and documents meet by block index.

Sources are a table, however many there are: their ranks, targets and quotas are
running sums and a few aggregates, and only scalars go to the driver. The order
of documents is by chunk (about CHUNK blocks) and then by key; all running sums
are taken in two levels, within chunks and over chunks, on rows without texts.

mix() gives whole documents: as many copies as the mix takes of their words, rounded so that
the rounded sums follow the exact ones from document to document; of OFFSETS starting points of that
rounding, each source gets the one that comes nearest to its target.

null source: a source of its own, ordered last. null or empty text: size 0,
nothing taken (mix() keeps such a document once). Very long texts: more blocks.
Repeated rows: taken each on its own. No rows: no rows. Columns
of other names pass through mix(); inner names start with two underscores.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged

BLOCK = 64
SHARD = 4096
#: Blocks of documents that are put in order in one place, and shards whose slots are numbered in one place.
CHUNK, SHARDS = 1 << 11, 1 << 12
#: No document is taken more often than this.
REPEATS = 3
#: Primes over 2**41, so none divides a number of blocks under that.
PRIMES = (2199023255579, 2199023255617, 2199023255623, 2199023255633, 2199023255677, 2199023255699, 2199023255713, 2199023255717)
#: Parts of a slot, or of a copy, that sums are taken in, so that they are exact in any order.
PARTS = 1 << 20
#: Places of the table in which a drawn number finds its source.
LOTS = 4096
OFFSETS = 32


def default_weight(rank: Column, source: Column) -> Column:
    """1, 2, 3, repeating, for sources in order."""
    return 1.0 + rank % 3


def before(rows: DataFrame, keys: list[str], chunk: str, order: list, value: Column, out: str) -> DataFrame:
    """rows with out: the sum of value (long) over rows of the same keys that come before by (chunk, order)."""
    sums = rows.groupBy(*keys, chunk).agg(F.sum(value).alias("__sum"))
    ahead = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, chunk, F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).cast("long").alias("__base"))
    inner = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(base, [*keys, chunk]).withColumn(out, F.col("__base") + F.coalesce(F.sum(value).over(inner), F.lit(0)).cast("long")).drop("__base")


def product(a: Column, b: Column, n: Column) -> Column:
    """a * b modulo n, for a, b < n < 2**41, in steps that a long holds."""
    high, low = F.shiftright(b, 20), b.bitwiseAND(F.lit((1 << 20) - 1))
    return F.pmod(F.pmod(F.pmod(a * high, n) * (1 << 20), n) + F.pmod(a * low, n), n)


class Mix:
    """The plan of a mix over docs; everything about slots follows from the seed and the sources' sizes."""

    def __init__(self, docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: Callable[[Column, Column], Column] = default_weight, block: int = BLOCK, seed: int = 7):
        """weights: a source's weight from its rank among the sources by code point (from 0, null last) and its name."""
        self.given, self.spark, self.block, self.seed = docs, docs.sparkSession, block, seed
        size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
        rows = docs.select(F.col(key).alias("__key"), F.col(source).cast("string").alias("__source"), size.alias("__size"), *self.names(docs))
        self.docs = staged(rows, "mix")
        self.sources = staged(self._sources(weights), "sources")
        self.slots_in_all = int(self.sources.agg(F.sum("quota")).first()[0] or 0)

    @staticmethod
    def names(docs: DataFrame) -> list[Column]:
        """__r1, __r2: 128 bits that name a row by all its columns (maps can't be hashed)."""
        cols = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
        return [F.xxhash64(*cols).alias("__r1"), F.xxhash64(F.lit(1), *cols).alias("__r2")]

    def _sources(self, weights) -> DataFrame:
        """__source, s (its rank), size, target, blocks, quota (slots), lot (quotas before)."""
        order = F.col("__source").asc_nulls_last()
        sums = self.docs.groupBy("__source").agg(F.sum("__size").alias("size"))
        sums = staged(sums.repartitionByRange(order).sortWithinPartitions(order).withColumn("part", F.spark_partition_id()), "ranks")
        rows = before(sums, [], "part", [order], F.lit(1).cast("long"), "s").withColumn("weight", weights(F.col("s"), F.col("__source")).cast("double"))
        full, cap = rows.where("size > 0 and weight > 0"), F.col("size") * REPEATS
        total, weight = full.agg(F.sum("size"), F.sum("weight")).first()
        left, weight, capped = total or 0, weight or 1.0, 0
        while True:
            over = F.lit(float(left)) * F.col("weight") > cap * F.lit(weight)
            n, words, open_ = full.agg(F.count(F.when(over, 1)), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
            if n == capped or not open_:
                break
            left, weight, capped = total - words, open_, n
        over = (F.lit(float(left)) * F.col("weight") > cap * F.lit(weight)) | (F.lit(bool(capped and not open_)))
        target = F.when((F.col("size") == 0) | (F.col("weight") <= 0), 0.0).when(over, cap.cast("double")).otherwise(F.lit(float(left)) * F.col("weight") / F.lit(weight))
        rows = rows.withColumn("target", target).withColumn("blocks", F.ceil(F.col("size") / self.block))
        # A source's slots by the words that its blocks really hold, as the last one may be short.
        exact = F.when(F.col("size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("size") * PARTS)).otherwise(0).cast("long")
        rows = before(rows.withColumn("parts", exact), [], "part", [order], F.col("parts"), "ahead")
        rows = rows.withColumn("quota", F.least(F.expr(f"(ahead + parts + {PARTS // 2}) div {PARTS} - (ahead + {PARTS // 2}) div {PARTS}"), F.col("blocks") * REPEATS))
        return before(rows, [], "part", [order], F.col("quota"), "lot").select("__source", "s", "part", "size", "target", "blocks", "quota", "lot")

    def placed(self) -> DataFrame:
        """The documents with __s, source_size, target, __at (the words of their source before them) and __row, their number in their chunk."""
        known = self.sources.select(F.col("__source").alias("__name"), F.col("s").alias("__s"), F.col("size").alias("source_size"), "target", "blocks")
        rows = self.docs.join(known, F.col("__source").eqNullSafe(F.col("__name")))
        chunk = F.pmod(F.xxhash64(F.lit(self.seed), "__r1", "__r2"), F.ceil((F.col("blocks") + 1) / CHUNK))
        rows = rows.withColumn("__chunk", chunk).drop("__source", "__name", "blocks")
        order = ["__key", "__r1", "__r2"]
        rows = before(rows, ["__s"], "__chunk", order, F.col("__size"), "__at")
        return rows.withColumn("__row", F.row_number().over(Window.partitionBy("__s", "__chunk").orderBy(*order)))

    def drawn(self) -> DataFrame:
        """shard, chunk, s, n: the slots that each shard draws for a source."""
        n = self.slots_in_all
        width = -(-n // LOTS) or 1
        # Some thousand rows and one more for each source: of a size that is known when the join is planned.
        lots = staged(self.sources.where("quota > 0").select("s", "lot", "quota", F.explode(F.expr(f"sequence(lot div {width}, (lot + quota - 1) div {width})")).alias("place")), "lots")
        tasks = max(self.spark.sparkContext.defaultParallelism, n >> 22)
        slots = self.spark.range(0, n, 1, tasks).select(F.expr(f"id div {SHARD}").alias("shard"), F.pmod(F.xxhash64(F.lit(self.seed), "id"), F.lit(n)).alias("x"))
        found = slots.withColumn("place", F.expr(f"x div {width}")).join(lots, "place").where("x >= lot and x < lot + quota")
        return staged(found.groupBy("shard", "s").agg(F.count("*").alias("n")).withColumn("chunk", F.expr(f"shard div {SHARDS}")), "drawn")

    def draws(self) -> DataFrame:
        """shard, chunk, s, n: the draws, with what is over a source's quota handed to those under theirs."""
        drawn = self.drawn()
        quotas = self.sources.select("s", "part", "quota")
        rows = before(drawn, ["s"], "chunk", ["shard"], F.col("n"), "start").join(quotas.drop("part"), "s")
        rows = rows.withColumn("kept", F.greatest(F.lit(0), F.least(F.col("n"), F.col("quota") - F.col("start"))))
        each = lambda df, n: df.withColumn("x", F.explode(F.expr(f"sequence(first, first + {n} - 1)")))
        over = rows.where("n > kept").select("shard", "chunk", "s", (F.col("n") - F.col("kept")).alias("more"))
        over = each(before(over, [], "chunk", ["shard", "s"], F.col("more"), "first"), "more").select("x", "shard", "chunk")
        total = drawn.groupBy("s").agg(F.sum("n").alias("total"))
        under = quotas.join(total, "s", "left").withColumn("lack", F.col("quota") - F.coalesce("total", F.lit(0))).where("lack > 0")
        under = each(before(under, [], "part", ["s"], F.col("lack"), "first"), "lack").select("x", "s")
        handed = over.join(under, "x").select("shard", "chunk", "s", F.lit(1).cast("long").alias("n"))
        return rows.where("kept > 0").select("shard", "chunk", "s", F.col("kept").alias("n")).unionByName(handed).groupBy("shard", "chunk", "s").agg(F.sum("n").alias("n"))

    def slots(self) -> DataFrame:
        """shard, s, slot, block of the whole mix."""
        if not self.slots_in_all:
            return self.spark.createDataFrame([], "shard long, s long, slot long, block long")
        rows = before(staged(self.draws(), "draws"), ["s"], "chunk", ["shard"], F.col("n"), "start").join(self.sources.select("s", "blocks"), "s")
        # A row becomes thousands of slots: the rows are dealt anew, or they would grow in as many tasks as there are sources.
        rows = rows.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "shard", "s")
        rows = rows.select("shard", "s", "blocks", F.explode(F.expr("sequence(start, start + n - 1)")).alias("slot"))
        turn = F.expr("slot div blocks")
        factor = F.element_at(F.array(*map(F.lit, PRIMES)), (F.pmod(F.xxhash64(F.lit(self.seed), "s", turn), F.lit(len(PRIMES))) + 1).cast("int"))
        shift = F.pmod(F.xxhash64(F.lit(self.seed + 1), "s", turn), F.col("blocks"))
        # The factor is prime and no divisor of blocks: i -> factor * i + shift is one to one.
        block = F.pmod(product(F.pmod(factor, F.col("blocks")), F.pmod("slot", "blocks"), F.col("blocks")) + shift, F.col("blocks"))
        return rows.select("shard", "s", "slot", block.alias("block"))

    def uses(self) -> DataFrame:
        """__s, __block, __uses of the blocks that the mix takes.

        Its size grows with the mix but can't be foreseen from the few shards it is made of, so a broadcast is ruled out.
        """
        return self.slots().groupBy(F.col("s").alias("__s"), F.col("block").alias("__block")).agg(F.count("*").alias("__uses")).hint("merge")

    def taken(self) -> DataFrame:
        """The documents as placed, with taken, the words that the mix takes of each."""
        pieces = self.placed().withColumn("__block", F.explode(F.expr(f"sequence(__at div {self.block}, greatest(__at + __size - 1, __at) div {self.block})")))
        words = F.greatest(F.lit(0), F.least(F.col("__at") + F.col("__size"), (F.col("__block") + 1) * self.block) - F.greatest("__at", F.col("__block") * self.block))
        rows = pieces.join(self.uses(), ["__s", "__block"], "left").withColumn("__words", words * F.coalesce("__uses", F.lit(0)))
        kept = ("__key", "__size", "__r1", "__r2", "source_size", "target")
        return rows.groupBy("__s", "__chunk", "__row").agg(*(F.first(c).alias(c) for c in kept), F.sum("__words").cast("long").alias("taken"))

    def report(self) -> DataFrame:
        """doc_id, size, source_size, target, taken."""
        return self.taken().select(F.col("__key").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target", "taken")

    def copies(self) -> DataFrame:
        """The documents as given, each as often as the mix takes its words; without words, once."""
        rows = staged(self.taken().withColumn("__f", F.expr(f"if(__size > 0, taken * {PARTS} div __size, 0L)")), "taken")
        rows = staged(before(rows, ["__s"], "__chunk", ["__row"], F.col("__f"), "__ahead"), "ahead")
        times = lambda u: F.expr(f"least((__ahead + __f + {u}) div {PARTS} - (__ahead + {u}) div {PARTS}, {REPEATS}L)")
        starts = [k * PARTS // OFFSETS for k in range(OFFSETS)]
        sums = rows.groupBy("__s").agg(F.first("target").alias("target"), *(F.sum(F.col("__size") * times(u)).alias(f"u{u}") for u in starts))
        best = staged(sums.select("__s", F.array_min(F.array(*(F.struct(F.abs(F.col(f"u{u}") - F.col("target")).alias("off"), F.lit(u).alias("u")) for u in starts)))["u"].alias("__u")), "offsets")
        rows = rows.join(best, "__s").withColumn("__times", F.when(F.col("__size") == 0, F.lit(1).cast("long")).otherwise(times("__u")))
        # Equal rows are one here, with the copies of all of them.
        rows = rows.groupBy("__r1", "__r2").agg(F.sum("__times").alias("__times")).where("__times > 0").hint("merge")
        named = self.given.select("*", *self.names(self.given))
        whole = named.join(rows, ["__r1", "__r2"]).dropDuplicates(["__r1", "__r2"])
        return whole.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select(*(F.col(f"`{c}`") for c in self.given.columns))


def report(docs: DataFrame) -> DataFrame:
    return Mix(docs).report()


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs mixed to the target weights, whole documents: the same columns, repeated or left out."""
    return Mix(docs, **options).copies()
