"""Nearest neighbours: exact search, hash index, multi-probe and adaptive search, re-ranking.

Points are (id, v), queries (q_id, v), v an array of doubles. The index is a long table (id, table_id, bucket_key), so a
probe is an equi-join that Catalyst may broadcast, shuffle or split where skewed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.hashing import HashFamily, bucket_key
from ..sources.scratch import keep as scratch_keep
from .blocks import near_pairs
from .nearest import nearest

#: Queries of one block of exact search.
BLOCK = 1024


def ranked(found: DataFrame, k: int, *, by: str = "dist", id_: str = "id") -> DataFrame:
    """The k nearest by query, ties to smaller ids, as (q_id, rn, id, dist)."""
    order = Window.partitionBy("q_id").orderBy(by, id_)
    return found.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).select("q_id", "rn", id_, by)


def exact_knn(points: DataFrame, queries: DataFrame, k: int = 10, metric: str = "euclidean", exclude_self: bool = True) -> DataFrame:
    """Exact neighbours: every pair is measured, block by block, and none is kept beyond its query's k of a block. Points of
    equal distance are taken by id; ids are longs."""
    return ranked(nearest(points, queries, k, metric, exclude_self), k)


def exact_knn_blocks(points: DataFrame, queries: np.ndarray, query_ids: np.ndarray, k: int = 10, exclude_self: bool = True) -> DataFrame:
    """Exact Euclidean neighbours for at most BLOCK queries, one matrix product per Arrow batch of points: each batch
    yields k rows a query at most. Call it per block for more queries."""
    if len(queries) > BLOCK:
        raise ValueError(f"at most {BLOCK} queries a block")
    size = (queries * queries).sum(1)

    def search(batches):
        for batch in batches:
            x, ids = np.stack(batch["v"].to_numpy()).astype(np.float64), batch["id"].to_numpy()
            d = np.sqrt(np.maximum(size[:, None] + (x * x).sum(1) - 2 * queries @ x.T, 0))
            if exclude_self:
                d[query_ids[:, None] == ids[None]] = np.inf
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            near = np.take_along_axis(d, best, 1)
            keep = np.isfinite(near)
            yield pd.DataFrame({"q_id": np.repeat(query_ids, best.shape[1])[keep.ravel()], "id": ids[best.ravel()][keep.ravel()], "dist": near.ravel()[keep.ravel()]})

    return ranked(points.select("id", "v").mapInPandas(search, "q_id long, id long, dist double"), k)


def build_index(points: DataFrame, family: HashFamily, radius: float = 1.0, arrow: bool = False, keep: tuple[str, ...] = (), dots: bool = False) -> DataFrame:
    """(id, table_id, bucket_key, and columns to keep): one row per point and table; with dots also the table's hashes before
    they are cut into bins."""
    if dots:
        hashed = points.select("id", *keep, family.shifted(F.col("v")).alias("dots"))
        tables = hashed.withColumn("table_id", F.explode(F.sequence(F.lit(0), F.lit(family.tables - 1))))
        own = F.slice("dots", F.col("table_id") * family.hashes + 1, family.hashes)
        return tables.withColumn("dots", own).select("id", "table_id", bucket_key(family.bins_of(F.col("dots"), radius)).alias("bucket_key"), "dots", *keep)
    bins = family.bins_arrow(radius)(F.col("v")) if arrow else family.bins(F.col("v"), radius)
    hashed = points.select("id", *keep, bins.alias("bins"))
    return hashed.select("id", F.posexplode(family.keys_of(F.col("bins"))).alias("table_id", "bucket_key"), *keep)


def bucket_sizes(index: DataFrame) -> DataFrame:
    return index.groupBy("table_id", "bucket_key").agg(F.count("*").alias("bucket_size"))


def table_stats(index: DataFrame) -> DataFrame:
    return index.groupBy("table_id").agg(F.count("*").alias("n_points"), F.countDistinct("bucket_key").alias("n_buckets"))


def materialised_tables(index: DataFrame) -> DataFrame:
    """(table_id, hash_value, point_indices): buckets with their sorted ids; as long as the longest bucket."""
    return index.groupBy("table_id", F.col("bucket_key").alias("hash_value")).agg(F.array_sort(F.collect_list("id")).alias("point_indices"))


def candidates(queries: DataFrame, index: DataFrame, family: HashFamily, probes: int = 1, radius: float = 1.0) -> DataFrame:
    """Distinct (q_id, id) that share a bucket, or one of the probed ones, in any table."""
    hashed = queries.select("q_id", family.bins(F.col("v"), radius).alias("bins"))
    tables = hashed.withColumn("table_id", F.explode(F.sequence(F.lit(0), F.lit(family.tables - 1))))
    probe = tables.select("q_id", "table_id", F.explode(family.probe_keys(F.col("bins"), F.col("table_id"), probes)).alias("bucket_key")).distinct()
    return probe.join(index, ["table_id", "bucket_key"]).select("q_id", "id").distinct()


def rerank(found: DataFrame, points: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean", exclude_self: bool = True) -> DataFrame:
    """Exact distances for candidates (q_id, id), and the k nearest of each query."""
    if exclude_self:
        found = found.where("q_id <> id")
    pairs = found.join(points.select("id", "v"), "id").join(queries.select("q_id", F.col("v").alias("q")), "q_id")
    return ranked(pairs.select("q_id", "id", vectors.distance(metric)(F.col("q"), F.col("v")).alias("dist")), k)


def hash_knn(points: DataFrame, queries: DataFrame, family: HashFamily, k: int = 10, probes: int = 1, metric: str | None = None) -> DataFrame:
    """The k nearest of each query's candidates, as candidates and rerank give them, but in blocks: no candidate is a row."""
    return ranked(nearest(points, queries, k, metric or family.metric, family=family, probes=probes), k)


def adaptive_search(index: DataFrame, queries: DataFrame, family: HashFamily, k: int, radii: list[float], probes: int = 1, exclude_self: bool = True) -> DataFrame:
    """(q_id, id, level): candidates of the first radius whose buckets hold at least 3k of them, of the last one for queries
    that none satisfies. Points are cut into wider bins from the index's dots; only queries still short of candidates go on
    to the next radius. For cosine, whose bins have no width, a level probes so many more flips of bits instead."""
    found, open_ = None, queries.select("q_id", "v")
    for level, radius in enumerate(radii):
        cosine = family.metric == "cosine"
        wider = index if level == 0 or cosine else index.withColumn("bucket_key", bucket_key(family.bins_of(F.col("dots"), radius)))
        more = candidates(open_, wider, family, probes + level * family.hashes if cosine else probes, radius)
        if exclude_self:
            more = more.where("q_id <> id")
        more = scratch_keep(more.withColumn("level", F.lit(level)), "candidates")
        if level == len(radii) - 1:
            return more if found is None else found.unionByName(more)
        enough = scratch_keep(more.groupBy("q_id").agg(F.count("*").alias("n")).where(F.col("n") >= 3 * k).select("q_id"), "enough")
        done = more.join(enough, "q_id", "left_semi")
        found = done if found is None else found.unionByName(done)
        open_ = scratch_keep(open_.join(enough, "q_id", "left_anti"), "open")
        if open_.isEmpty():
            return found
    raise ValueError("no radius to search")


def adaptive_candidates(points: DataFrame, queries: DataFrame, family: HashFamily, k: int, levels: int = 5, expansion: float = 2.0, radius: float = 1.0) -> DataFrame:
    """The same over points, hashed once."""
    index = scratch_keep(build_index(points, family, dots=True), "index")
    return adaptive_search(index, queries, family, k, [radius * expansion**i for i in range(levels)])


def radius_neighbours(points: DataFrame, eps: float, metric: str = "euclidean", cells: int | None = None) -> DataFrame:
    """(a, b, dist) for a < b at most eps apart: see blocks.near_pairs."""
    vectors.distance(metric)  # refuses unknown ones
    return near_pairs(points, eps, metric, cells)


def overlap(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(recall): mean part of the k true neighbours found, over all queries of truth."""
    both = truth.select("q_id", "id").join(found.select("q_id", "id", F.lit(1).alias("hit")), ["q_id", "id"], "left")
    return both.groupBy("q_id").agg((F.count("hit") / k).alias("r")).agg(F.avg("r").alias("recall"))


def with_density(points: DataFrame, key: Column, inverse: bool = True, eps: float = 1e-10) -> DataFrame:
    """Add bucket_key, bucket_size and weight: 1 / (size + eps), or the size. Sizes are pre-aggregated, written and joined,
    so that a bucket of any size is neither sorted nor held by one task."""
    keyed = points.withColumn("bucket_key", key)
    sizes = scratch_keep(keyed.groupBy("bucket_key").agg(F.count("*").alias("bucket_size")), "sizes")
    out = keyed.join(sizes, "bucket_key")
    return out.withColumn("weight", 1 / (F.col("bucket_size") + eps) if inverse else F.col("bucket_size").cast("double"))
