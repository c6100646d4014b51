"""Connected components by rounds of joins over written tables; no list of links or of components leaves the tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import drop, keep

#: Edges that a task holds at once.
LOT = 1_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of the edges u-v as (child, root) pairs, one per vertex that isn't its component's minimum."""
    ids, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inverse[: len(u)], inverse[len(u) :]
    root = np.arange(len(ids))
    while True:
        ra, rb = root[a], root[b]
        if np.array_equal(ra, rb):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root = up
    child = root != np.arange(len(ids))
    return ids[child], ids[root[child]]


def spanning(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, with the same components: each task hangs the vertices of its own edges on the least they reach."""

    def local(batches):
        u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            u, v = np.concatenate([u, batch.column(0).to_numpy()]), np.concatenate([v, batch.column(1).to_numpy()])
            if len(u) >= LOT:
                u, v = forest(u, v)
                if len(u) >= LOT // 2:  # too many vertices to go on with
                    yield pa.record_batch([pa.array(u), pa.array(v)], ["u", "v"])
                    u, v = u[:0], v[:0]
        u, v = forest(u, v)
        yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL").mapInArrow(local, "u long, v long")


def _grown(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row.n, row.x


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hang every larger neighbour of u on the least vertex next to u. Gives a kept table and the edges that read it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star")
    return least, both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hang the smaller neighbours of u, and u, on the least of them. Edges run from the larger u to the smaller v."""
    least = keep(edges.groupBy("u").agg(F.min("v").alias("m")), "star")
    hung = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least, hung.union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v) of longs: (u, v) with v the least vertex of u's component, for every
    vertex that isn't its component's least. Tasks join what they can on their own; then large-star and small-star rounds
    alternate until nothing changes, which takes about as many as the square of the logarithm of the vertices at most. Each
    round is written to the shared folder and the one before dropped. Loops and repeated edges are allowed, no edges give no
    rows."""
    now = keep(spanning(edges).distinct(), "edges")
    if now.groupBy("u").count().where("count > 1").isEmpty() and now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
        return now  # every vertex hangs on one that hangs on none
    mark, before = _grown(now), None
    while mark[0] and mark != before:
        for star in (_large_star, _small_star):
            least, new = star(now)
            old, now = now, keep(new, "edges")
            drop(least, old)
        mark, before = _grown(now), mark
    return now
