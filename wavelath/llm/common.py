"""What the training-data operators share: table reading, shared storage, graph components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import fresh_path, shared_dir, staged

#: Java pattern of the separators between words: space and the ASCII controls tab to return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Edges whose components one task finds; more are shortened in rounds first.
SMALL = 1 << 20
__all__ = ["SPACE", "WORD", "components", "dealt", "fresh_path", "shared_dir", "small_batches", "staged", "table", "with_default"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """df dealt out anew: an aggregate that is joined by its own key would else share a stage with the join,
    and a hot key's rows could not be split; now both sides of the join are plain shuffles."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def small_batches(spark: SparkSession, rows: int = 512, width: int = 1 << 26) -> None:
    """Bounds what one Arrow batch of this session holds, rows and bytes, so that very long texts don't fill a Python worker."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", width)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{key}").removesuffix("b"))
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def with_default(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings; null becomes the empty string."""
    return [x or "" for x in batch.column(name).to_pylist()]


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of edges, ascending, and the least id that each reaches."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        x, y = root[left], root[right]
        on = x != y
        if not on.any():
            return ids, ids[root]
        left, right, x, y = left[on], right[on], x[on], y[on]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _in_one_task(links: DataFrame) -> DataFrame:
    def run(batches):
        rows = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
        if rows:
            ids, least = least_reachable(*(np.concatenate(x) for x in zip(*rows, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(least, pa.int64())], ["id", "component"])

    return links.coalesce(1).mapInArrow(run, "id long, component long")


def components(edges: DataFrame, rounds: int = 60, few: int = SMALL) -> DataFrame:
    """Connected components of edges (a, b), both long: (id, component), component the least id reachable.

    Up to few edges, one task finds them: each round is several exchanges and broadcasts, which the driver
    pays for whatever the number of rows. More edges go through rounds until as few are left or nothing changes.

    Every round each vertex hands its least known neighbour to all its neighbours
    (hook to the least neighbour, then shorten), which halves the remaining paths,
    so the rounds grow with the logarithm of the longest path. Each round is written to
    the shared folder. Joins by a vertex with very many neighbours can be split. No edges: no rows.
    """
    links = staged(edges.where("a is not null and b is not null and a <> b").selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct(), "edges")
    state = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
    now = state(links)
    for _ in range(rounds):
        if now[0] <= few:
            return _in_one_task(links)
        # Large star: each vertex links its larger neighbours to the least of its neighbours and itself.
        both = links.selectExpr("a as u", "b as v").unionAll(links.selectExpr("b as u", "a as v"))
        low = dealt(both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m"))
        large = both.where("v > u").join(low, "u").selectExpr("m as a", "v as b").where("a <> b").distinct()
        # Small star: each vertex links its smaller neighbours and itself to the least of them.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(dealt(low), "b").where("a <> m").selectExpr("m as a", "a as b")
        links = staged(small.unionAll(low.selectExpr("m as a", "b")).distinct(), "edges")
        last, now = now, state(links)
        if last == now:
            break
    else:
        raise RuntimeError("components did not settle")
    return links.selectExpr("b as id", "a as component").unionAll(links.selectExpr("a as id", "a as component").distinct())
