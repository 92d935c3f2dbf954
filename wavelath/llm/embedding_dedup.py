"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors are compared only within a label (and dimension). Equal vectors are
taken together first, with their number. The rest are made unit vectors and
turned into the basis of principal axes, of falling weight. A cell is an interval of
the first coordinate as wide as the distance at the threshold, so partners lie in
the same or the next cell. Within a cell vectors are cut into blocks of about BLOCK in
the order of the second coordinate (by fine bins of it, whose sizes are summed up; a bin over BLOCK is parted by hash).
Blocks know the least and greatest of their LEAD leading coordinates; only pairs of blocks
that no leading axis holds further apart than the threshold's distance become tiles and are shuffled.

In a tile products are accumulated over leading coordinates first; what the
others can add is at most the product of the norms of the suffixes. A pair whose
bound falls under the threshold stops there. A pair that gets to the end is
decided by the cosine of the vectors as given, in double precision. A tile gives counts of
links and a spanning forest of them, never its pairs, and holds at most PART numbers of pairs at once.
Where vectors don't spread along the leading axes, the work stays quadratic in a label's distinct vectors.

null ids or labels, null, empty or zero vectors, and vectors with null or non-finite
components link with nothing. Very small and very large components: scaled first. Repeated rows: each a vector of its own. Vectors of
different lengths don't link. No rows: no rows. Only the named columns are read, so others, whatever their names, don't matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, dealt, staged

BLOCK = 1024
#: Leading coordinates by which pairs of blocks are left out; bins of a coordinate's unit length.
LEAD, BINS = 8, 4096
#: Numbers of pairs' coordinates held at once.
PART = 1 << 21
#: Coordinates added at a time; the bound is tested in between.
STEPS = (8, 16, 32)
MARGIN = 1e-9


def unit(rows: list) -> np.ndarray:
    """Vectors of one length as unit vectors in double precision; scaled first, so that no square over- or underflows."""
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def axes(reps: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes for each dimension, as columns, of all unit vectors.

    A task sends out its Gram matrix row by row, and each row is summed on its own, so no
    task holds more than one row of every task's matrix.
    """

    def total(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        line = sum(np.frombuffer(x, np.float64) for x in rows["line"])
        return pd.DataFrame({"d": [key[0]], "i": [key[1]], "line": [line.tobytes()]})

    found = reps.select("v").mapInArrow(_gram, "d long, i long, line binary").groupBy("d", "i").applyInPandas(total, "d long, i long, line binary").collect()
    lines: dict[int, dict[int, np.ndarray]] = {}
    for r in found:
        lines.setdefault(r["d"], {})[r["i"]] = np.frombuffer(r["line"], np.float64)
    out = {}
    for d, own in lines.items():
        values, vectors = np.linalg.eigh(np.stack([own[i] for i in range(d)]))
        out[d] = vectors[:, np.argsort(-values)]
    return out


def _gram(batches):
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        rows: dict[int, list] = {}
        for x in b.column("v").to_pylist():
            rows.setdefault(len(x), []).append(x)
        for d, xs in rows.items():
            u = unit(xs)
            sums[d] = sums.get(d, 0) + u.T @ u
    for d, gram in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int64()), pa.array(range(d), pa.int64()), pa.array([x.tobytes() for x in gram], pa.binary())], ["d", "i", "line"])


def suffix_norms(x: np.ndarray, at: int) -> np.ndarray:
    return np.sqrt(np.maximum((x[:, at:] ** 2).sum(1), 0.0))


def candidates(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b, unit vectors in the axes' basis, whose product may reach the threshold."""
    least, d, at = threshold - MARGIN, a.shape[1], min(STEPS[0], a.shape[1])
    product = a[:, :at] @ b[:, :at].T
    i, j = np.nonzero(product + suffix_norms(a, at)[:, None] * suffix_norms(b, at)[None, :] >= least)
    product = product[i, j]
    for stop in [*(s for s in STEPS[1:] if s < d), d]:
        if at >= d or not len(i):
            break
        if 8 * len(i) > len(a) * len(b):
            product = product + (a[:, at:stop] @ b[:, at:stop].T)[i, j]
        else:
            product = product + dots(a[:, at:stop], b[:, at:stop], i, j)
        at = stop
        stay = product + suffix_norms(a, at)[i] * suffix_norms(b, at)[j] >= least
        i, j, product = i[stay], j[stay], product[stay]
    return i, j


def dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows i of a and rows j of b, PART numbers at a time."""
    step = max(1, PART // max(1, a.shape[1]))
    parts = [(a[i[k : k + step]] * b[j[k : k + step]]).sum(1) for k in range(0, len(i), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Spanning edges of the links i-j among n vertices."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def links(vectors: DataFrame, threshold: float = 0.98, key: str = "vec_id", label: str = "label", embedding: str = "embedding", block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors."""
    spark = vectors.sparkSession
    kind = "array<float>" if dict(vectors.dtypes)[embedding] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(embedding).cast(kind).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(F.coalesce(fit, F.lit(False)), F.col("v")))
    # Equal vectors: one of them stands for all; sums are taken map-side first, so a very common vector is no hot key.
    # Two 64-bit hashes, with seeds of their own, name a vector: one alone would meet its like among some billions.
    given = F.col("v").isNotNull()
    rows = rows.withColumn("h", F.when(given, F.xxhash64("label", "v"))).withColumn("h2", F.when(given, F.xxhash64(F.lit(1), "label", "v")))
    reps = staged(rows.where("v is not null").groupBy("h", "h2", "label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("many")), "vectors")
    turn = axes(reps)
    width = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6

    def place(batches):
        for b in batches:
            vs = b.column("v").to_pylist()
            sizes = np.array([len(v) for v in vs], np.int64)
            lead = np.zeros((len(vs), LEAD))
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                own = unit([vs[k] for k in at.tolist()]) @ turn[d][:, :LEAD]
                lead[at, : own.shape[1]] = own
            more = [pa.array(np.floor(lead[:, 0] / width).astype(np.int64)), pa.array(np.floor(lead[:, 1] * BINS).astype(np.int64)), pa.array(sizes), *(pa.array(x) for x in lead.T)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "cell", "bin", "d", *leads])

    leads = [f"x{k}" for k in range(LEAD)]
    schema = reps.schema.simpleString()[7:-1].replace(":", " ") + ", cell long, bin long, d long, " + ", ".join(f"{c} double" for c in leads)
    placed = staged(reps.mapInArrow(place, schema), "placed")
    # One row for each bin of a cell, at most 2 * BINS: runs of bins are blocks.
    bins = placed.groupBy("label", "d", "cell", "bin").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("label", "d", "cell").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = dealt(bins.select("label", "d", "cell", "bin", "n", F.expr(f"n > {block}").alias("dense"), F.floor(ahead / block).alias("run")))
    sub = F.when(F.col("dense"), F.pmod(F.xxhash64("h"), F.ceil(F.col("n") / block)))
    name = F.xxhash64("cell", "run", F.when(F.col("dense"), F.col("bin")), sub)
    blocked = staged(placed.join(bins, ["label", "d", "cell", "bin"]).select("label", "d", "cell", name.alias("block"), "rep", "many", "v", *leads), "blocks")
    boxes = blocked.groupBy("label", "d", "cell", "block").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in leads for f in (F.min, F.max)))
    side = lambda n: boxes.select("label", "d", *(F.col(c).alias(f"{c}{n}") for c in boxes.columns[2:]))
    near = side(0).withColumn("cell1", F.explode(F.array("cell0", F.col("cell0") + 1))).join(side(1), ["label", "d", "cell1"])
    near = near.where((F.col("cell0") < F.col("cell1")) | (F.col("block0") <= F.col("block1")))
    for c in leads:
        near = near.where((F.col(f"min_{c}1") - F.col(f"max_{c}0") <= width) & (F.col(f"min_{c}0") - F.col(f"max_{c}1") <= width))
    near = staged(near.select("label", "d", "block0", "block1"), "tiles")
    rows_of = lambda n: blocked.join(near.where("block0 <> block1" if n else "true").withColumn("block", F.col(f"block{n}")), ["label", "d", "block"]).select("label", "d", "block0", "block1", F.when(F.col("block0") == F.col("block1"), 2).otherwise(n).alias("side"), "rep", "many", "v")
    tiles = rows_of(0).unionByName(rows_of(1))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        side = rows["side"].to_numpy()
        mine, other = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        empty = pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        if not len(mine) or not len(other):
            return empty
        raw = unit(rows["v"].tolist())
        turned = raw @ turn[raw.shape[1]]
        i, j = candidates(turned[mine], turned[other], threshold)
        i, j = mine[i], other[j]
        keep = (i < j) if (side == 2).any() else np.ones(len(i), bool)
        i, j = i[keep], j[keep]
        ok = dots(raw, raw, i, j) >= threshold
        i, j = i[ok], j[ok]
        if not len(i):
            return empty
        rep, many = rows["rep"].to_numpy(), rows["many"].to_numpy()
        n = np.bincount(i, many[j], len(rows)) + np.bincount(j, many[i], len(rows))
        linked = np.flatnonzero(n)
        edges = forest(i, j, len(rows))
        return pd.concat([pd.DataFrame({"a": rep[linked], "b": rep[linked], "n": n[linked].astype("int64")}), pd.DataFrame({"a": [rep[x] for x, _ in edges], "b": [rep[y] for _, y in edges], "n": [0] * len(edges)})])

    found = staged(tiles.groupBy("label", "d", "block0", "block1").applyInPandas(compare, "a long, b long, n long"), "links")
    joined = components(found.where("n = 0").select("a", "b"))
    counts = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    known = reps.select("h", "h2", "rep", "many").join(counts, "rep", "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("h", "h2", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("id", "h", "h2").join(known, ["h", "h2"], "left")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


ORACLE = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
r(id, c) as (select vec_id, vec_id from v union select p.b, r.c from r join p on p.a = r.id),
m as (select id, min(c) as c from r group by id),
n as (select a, count(*) as n from p group by a)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(m.c, e.vec_id) as component_id, coalesce(m.c, e.vec_id) = e.vec_id as kept
from embeddings e left join m on m.id = e.vec_id left join n on n.a = e.vec_id
"""
