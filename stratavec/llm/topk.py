"""Exact top-k inner products by MaxScore.

Vectors are cut into shards, queries into blocks. In a shard a query's terms are its components, and a vector's impact for
a term is its distance from the shard's least value there (from the greatest, for negative weights), so impacts aren't
negative and each term has a score bound. Terms are split into essential and non-essential: the bounds of all non-essential
ones together can't reach the k-th score so far. Essential postings are traversed, for some queries at a time as one matrix
product; the other terms are probed, heaviest first, only while vectors are competitive, and one by one once few are. The
k-th score so far goes on from shard to shard in a task. The shards' lists are merged by query.

Queries and shards meet in blocks: partitions of both are read as they were written, and each pair is one row with two
packed blocks. Nothing is copied or shuffled for it, and no task holds all queries or all vectors.

Vectors that are null, or hold null or non-finite components, take no part, nor do rows without an id. A query is
matched with vectors of its own length. Rows that share the query's id are its own. Where several rows share a query
id, the least vector is the query. Ties go to the smaller id. Scores must fit a long. No vectors or no queries give no rows.
Only vec_id and embedding are read, so other columns of any name don't matter."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARD_ROWS, QUERY_ROWS = 4096, 2048
#: Queries of one matrix product.
STRIP = 256
SEED_ROWS = 256
STEP = 16
#: Vectors are probed one by one once fewer than one in so many is competitive, so many at a time.
FEW, PROBED = 32, 1 << 16


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>) of the vectors that take part: floor(scale * x), x as double."""
    whole = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return vectors.where(whole).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(dim, block, ids, kind, data): up to size vectors of one length, packed as the shortest integers that hold them."""

    def pack(batches):
        waiting: dict[int, list] = {}

        def out(dim):
            ids, data = zip(*waiting.pop(dim), strict=True)
            ids, data = np.array(ids, np.int64), np.array(data, np.int64).reshape(len(ids), dim)
            kind = next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= data.min(initial=0) and data.max(initial=0) <= np.iinfo(t).max)
            return pa.record_batch([pa.array([dim], pa.int32()), pa.array([int(ids[0])], pa.int64()), pa.array([ids.tobytes()]), pa.array([kind]), pa.array([data.astype(kind).tobytes()])], ["dim", "block", "ids", "kind", "data"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = v.values.to_numpy()
                waiting.setdefault(len(v), []).append((i, v))
                if len(waiting[len(v)]) >= size:
                    yield out(len(v))
        for dim in list(waiting):
            yield out(dim)

    return rows.select("vec_id", "v").mapInArrow(pack, "dim int, block long, ids binary, kind string, data binary")


def _exact(q: np.ndarray, x: np.ndarray) -> type:
    """The cheapest type in which no sum of products of these integers is rounded."""
    most = float((np.abs(q.astype(np.float64)).max(0, initial=0) * np.abs(x.astype(np.float64)).max(0, initial=0)).sum())
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest of each row."""
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def max_score(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, best: np.ndarray | None = None):
    """Yield (query ids, ids, scores) with each query's k best vectors of one shard, its own id left out, as far as they may
    be among its k best of all. best holds the k highest scores that each query has from other shards, and gets this one's."""
    kind = _exact(queries, vectors)
    best = np.full((len(queries), k), -np.inf) if best is None else best
    x = vectors.astype(kind)
    low, high = x.min(0), x.max(0)
    for at in range(0, len(queries), STRIP):
        part = slice(at, at + STRIP)
        places, found, scores = _strip(query_ids[part], queries[part].astype(kind), ids, x, low, high, k, best[part])
        order = np.lexsort((ids[found], -scores, places))
        places, found, scores = places[order], found[order], scores[order]
        rank = np.arange(len(places)) - np.searchsorted(places, places)
        near = rank < k
        places, found, scores, rank = places[near], found[near], scores[near], rank[near]
        if kind is not np.int64:
            more = np.full((len(best[part]), k), -np.inf)
            more[places, rank] = scores
            best[part] = -np.partition(-np.concatenate([best[part], more], axis=1), k - 1, axis=1)[:, :k]
        yield query_ids[part][places], ids[found], scores.astype(np.int64)


def _strip(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, best: np.ndarray):
    """(places of queries, places of vectors, scores) of the competitive vectors of some queries."""
    sorted_ = np.argsort(query_ids)
    mine = sorted_[np.minimum(np.searchsorted(query_ids, ids, sorter=sorted_), len(sorted_) - 1)]
    theirs = np.flatnonzero(query_ids[mine] == ids)  # vectors of a query's own id,
    mine = mine[theirs]  # and its place; a block's queries have different ids
    if x.dtype == np.int64:  # products of integers that no float holds have no bounds in floats
        sums = q @ x.T
        spare = int(np.bincount(mine, minlength=1).max())
        fit = sums >= _kth(sums, k + spare)[:, None] if len(ids) > k + spare else np.ones(sums.shape, bool)
        fit[mine, theirs] = False
        i, j = np.nonzero(fit)
        return i, j, sums[i, j]
    floor = best.min(1)
    if len(ids) >= k and not np.isfinite(floor).all():
        seed = q @ x[:SEED_ROWS].T
        early = theirs < SEED_ROWS
        seed[mine[early], theirs[early]] = -np.inf
        if seed.shape[1] >= k:
            floor = np.maximum(floor, _kth(seed, k))
    bound = np.abs(q).astype(np.float64) * (high - low)
    order = np.argsort(-bound.sum(0), kind="stable")
    offset = np.where(q > 0, q * low, q * high).astype(np.float64)[:, order]
    least = np.concatenate([np.zeros((len(q), 1)), np.cumsum(offset, axis=1)], axis=1)  # of the terms before
    most = (offset + bound[:, order])[:, ::-1].cumsum(1)[:, ::-1]
    most = np.concatenate([most, np.zeros((len(q), 1))], axis=1)  # of the terms from here on
    open_ = np.flatnonzero(most[:, 0] >= floor)
    none = np.zeros(0, np.int64)
    if not len(open_):
        return none, none, np.zeros(0, x.dtype)
    q, least, most, floor = q[open_][:, order], least[open_], most[open_], floor[open_]
    needed = floor[:, None] - most - 4  # of the terms before, at least; the 4 is for floats that round
    at = int((least + most >= floor[:, None]).sum(1).max())  # the essential terms: from there on, the least of those before and the most of the rest fall short
    at = min(max(at, 1), len(order))
    x = x[:, order]
    sums = q[:, :at] @ x[:, :at].T
    place = np.full(len(best), -1)
    place[open_] = np.arange(len(open_))
    sums[place[mine][place[mine] >= 0], theirs[place[mine] >= 0]] = -np.inf
    while True:
        alive = sums >= needed[:, at].astype(x.dtype)[:, None]
        if at == len(order) or np.count_nonzero(alive) * FEW < alive.size:
            break
        step = slice(at, min(at + STEP, len(order)))
        sums += q[:, step] @ x[:, step].T
        at = step.stop
    i, j = np.divmod(np.flatnonzero(alive), len(ids))
    scores = sums[i, j]
    if at < len(order):
        for some in (slice(n, n + PROBED) for n in range(0, len(i), PROBED)):
            scores[some] += np.einsum("pd,pd->p", q[i[some], at:], x[j[some], at:])
    fit = (scores >= floor[i]) & (scores > -np.inf)
    return open_[i[fit]], j[fit], scores[fit]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query (vec_id, v) its k highest inner products with vectors (vec_id, v)
    of other ids; all, if fewer."""
    # Blocks are few beside their vectors, and dealt out, as the tasks that made them are those of the files.
    tasks = vectors.sparkSession.sparkContext.defaultParallelism
    shards = common.keep(_blocks(vectors, SHARD_ROWS).repartition(tasks), "shards")
    asked = common.keep(_blocks(queries.groupBy("vec_id").agg(F.min("v").alias("v")), QUERY_ROWS).repartition(tasks), "asked")
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns])
    # Not an equation, by which all blocks of one length would be dealt to one task.
    pairs = shards.join(asked, (F.col("dim") <= F.col("q_dim")) & (F.col("dim") >= F.col("q_dim"))).select("dim", "ids", "kind", "data", "q_block", "q_ids", "q_kind", "q_data")

    def search(batches):
        so_far: dict[tuple, np.ndarray] = {}  # by block of queries, their k highest scores in this task
        for batch in batches:
            for row in batch.to_pylist():
                ids, q_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                data, q_data = np.frombuffer(row["data"], row["kind"]).reshape(len(ids), row["dim"]), np.frombuffer(row["q_data"], row["q_kind"]).reshape(len(q_ids), row["dim"])
                best = so_far.setdefault((row["dim"], row["q_block"]), np.full((len(q_ids), k), -np.inf))
                for query_id, vec_id, score in max_score(q_ids, q_data, ids, data, k, best):
                    if len(vec_id):
                        yield pa.record_batch([pa.array(query_id), pa.array(vec_id), pa.array(score)], ["query_id", "vec_id", "score"])

    found = common.bounded(pairs).mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
