"""Nearest neighbours in blocks, exact or among the candidates of a hash index.

Points and queries are packed into blocks, with the buckets that points lie in and queries probe. Each block of queries meets
each of points in one row, as their partitions were written; nothing is copied or shuffled for it. There a bucket's postings
are a bitmap over the block, and a query's candidates are the union of its buckets' bitmaps. Distances of candidates come
from a matrix product, or one by one where candidates are few; those that may be among the k nearest are measured anew, sums
in the order of the column functions, so that equal vectors have equal distances. The k-th distance so far goes on from
block to block in a task. No pair leaves a task but the nearest of each block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import HashFamily
from ..sources.scratch import keep
from .blocks import MEASURES

POINTS, QUERIES = 4096, 2048
#: Queries of one matrix product.
STRIP = 256
#: Pairs are measured one by one where fewer than one in so many are candidates; so many at a time.
FEW, MEASURED = 32, 1 << 14
#: What rounding may add to a distance from a matrix product, in parts of the numbers that it is made of.
SLACK = 1e-12


def _vectors(batch: pa.RecordBatch, dim: int | None, finite: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of a batch (id, v), by length; vectors that are null or hold nulls take no part, nor do those of
    another length than dim, or of numbers that aren't finite if finite."""
    ids, column = batch.column(0), batch.column(1)
    numbers, lengths = column.flatten(), np.diff(column.offsets.to_numpy())
    if ids.null_count or column.null_count or numbers.null_count or len(set(lengths.tolist())) != 1:
        by_length: dict[int, list] = {}
        for i, v in zip(ids.to_pylist(), column.to_pylist(), strict=True):
            if i is not None and v is not None and None not in v:
                by_length.setdefault(len(v), []).append((i, v))
        made = [(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64).reshape(len(rows), n)) for n, rows in by_length.items()]
    else:
        made = [(ids.to_numpy(zero_copy_only=False).astype(np.int64), numbers.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1))]
    for i, x in made:
        if dim is None or x.shape[1] == dim:
            fit = np.isfinite(x).all(1) if finite else np.ones(len(x), bool)
            yield i[fit], x[fit]


def _packed(rows: DataFrame, size: int, buckets: Callable[[np.ndarray], np.ndarray] | None, dim: int | None) -> DataFrame:
    """(dim, block, ids, kind, data, keys, place) of rows (id, v): up to size vectors of one length, as floats of 32 bits if
    those hold them; the keys of the block's buckets, and by vector the places of its own among them."""

    def out(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        with np.errstate(over="ignore"):
            kind = "<f4" if np.array_equal(x.astype("<f4"), x, equal_nan=True) else "<f8"
        keys, place = [], b""
        if buckets:
            own = buckets(x)  # (rows, buckets of a row, numbers of a key), 32-bit
            wide = np.ascontiguousarray(own.reshape(-1, own.shape[2])).view(np.dtype((np.void, 4 * own.shape[2]))).ravel()
            found, at = np.unique(wide, return_inverse=True)
            keys, place = [k.tobytes() for k in found], at.astype(np.int32).tobytes()
        return pa.record_batch([
            pa.array([x.shape[1]], pa.int32()), pa.array([int(ids[0])], pa.int64()), pa.array([ids.tobytes()]), pa.array([kind]), pa.array([x.astype(kind).tobytes()]),
            pa.array([keys], pa.list_(pa.binary())), pa.array([place], pa.binary()),
        ], ["dim", "block", "ids", "kind", "data", "keys", "place"])

    def pack(batches):
        waiting: dict[int, list] = {}
        for batch in batches:
            for ids, x in _vectors(batch, dim, buckets is not None):
                waiting.setdefault(x.shape[1], []).append((ids, x))
                if sum(len(i) for i, _ in waiting[x.shape[1]]) >= size:
                    ids, x = (np.concatenate(part) for part in zip(*waiting.pop(x.shape[1]), strict=True))
                    whole = len(ids) // size * size
                    for at in range(0, whole, size):
                        yield out(ids[at : at + size], x[at : at + size])
                    if whole < len(ids):
                        waiting[x.shape[1]] = [(ids[whole:], x[whole:])]
        for rest in waiting.values():
            ids, x = (np.concatenate(part) for part in zip(*rest, strict=True))
            if len(ids):
                yield out(ids, x)

    made = rows.mapInArrow(pack, "dim int, block long, ids binary, kind string, data binary, keys array<binary>, place binary")
    # Dealt out, as the tasks of what follows are those of the files; blocks are few beside their vectors.
    return keep(made.repartition(rows.sparkSession.sparkContext.defaultParallelism), "blocks")


def _in_order(x: np.ndarray) -> np.ndarray:
    """Sums of rows, added from the first number on, as columns do it."""
    return np.cumsum(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def _norms(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.sqrt(_in_order(x * x)), 1e-10)


def measured(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the rows of q to those of x, one to one, bit by bit those of functions.vectors."""
    if metric == "cosine":
        return 1 - _in_order(q * x) / (_norms(q) * _norms(x))
    return np.sqrt(_in_order((q - x) * (q - x))) if metric == "euclidean" else _in_order(np.abs(q - x))


class _Points:
    """A block of points, made ready for many blocks of queries."""

    def __init__(self, row: dict, metric: str):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.x = np.frombuffer(row["data"], row["kind"]).reshape(len(self.ids), -1).astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            size = (self.x * self.x).sum(1)
            self.reach = size[np.isfinite(size)].max(initial=0)
            if metric == "euclidean":
                self.wide = np.concatenate([self.x, size[:, None]], axis=1)
            elif metric == "cosine":
                self.wide = self.x / _norms(self.x)[:, None]
        self.keys = {k: i for i, k in enumerate(row["keys"])}
        n = len(self.ids)
        self.bits = np.zeros((len(self.keys) + 1, -(-n // 8)), np.uint8)  # the last one for buckets that aren't here
        if self.keys:
            for own in np.frombuffer(row["place"], np.int32).reshape(n, -1).T:
                found, at = np.unique(own, return_inverse=True)  # a table's buckets
                holds = np.zeros((len(found), n), bool)
                holds[at, np.arange(n)] = True
                self.bits[found] = np.packbits(holds, axis=1)

    def near(self, q: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], np.ndarray]]:
        """What ranks the points for each query, near enough; how far it may be off; and what a distance is on that scale."""
        if metric == "cosine":
            return (q / -_norms(q)[:, None]) @ self.wide.T, np.full(len(q), 4 * SLACK), lambda d: d - 1
        size = (q * q).sum(1)
        if metric == "manhattan":
            return np.stack([MEASURES[metric](v, self.x) for v in q]), SLACK * np.sqrt(q.shape[1] * (size + self.reach)), lambda d: d
        return np.concatenate([-2 * q, np.ones((len(q), 1))], axis=1) @ self.wide.T, 4 * SLACK * (size + self.reach), lambda d: d * d - size


def _strip(points: _Points, q_ids: np.ndarray, q: np.ndarray, codes: np.ndarray | None, best: np.ndarray, k: int, metric: str, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of queries, places of points, distances) of the k nearest of each of some queries, as far as they may be
    among its k nearest of all; best holds the k least distances that each has from other blocks, and gets this one's."""
    n, fit = len(points.ids), None
    if codes is not None:
        union = points.bits[codes[:, 0]]
        for code in codes.T[1:]:
            union |= points.bits[code]
        if not union.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        fit = np.unpackbits(union, axis=1, count=n).view(bool)
    if exclude_self and len(own := np.flatnonzero(np.isin(points.ids, q_ids))):
        fit = np.ones((len(q), n), bool) if fit is None else fit
        fit[:, own] &= q_ids[:, None] != points.ids[own][None]
    with np.errstate(over="ignore", invalid="ignore"):
        if fit is None or np.count_nonzero(fit) * FEW > fit.size:
            rough, slack, scale = points.near(q, metric)
            if fit is not None:
                rough[~fit] = np.inf
            bound = scale(best[:, k - 1])
            new = np.flatnonzero(~np.isfinite(bound))
            if len(new) and n > k:
                bound[new] = np.partition(rough[new], k - 1, axis=1)[:, k - 1] + slack[new]
            alive = ~(rough > (bound + slack)[:, None])
            fit = alive if fit is None else alive & fit
        i, j = np.divmod(np.flatnonzero(fit), n)
        d = np.concatenate([np.zeros(0), *(measured(q[i[at : at + MEASURED]], points.x[j[at : at + MEASURED]], metric) for at in range(0, len(i), MEASURED))])
    order = np.lexsort((points.ids[j], d, i))
    i, j, d = i[order], j[order], d[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    near = (rank < k) & ~(d > best[i, k - 1])
    i, j, d, rank = i[near], j[near], d[near], rank[near]
    more = np.full((len(q), k), np.inf)
    more[i, rank] = d
    best[:] = np.sort(np.concatenate([best, more], axis=1), axis=1)[:, :k]
    return i, j, d


def nearest(points: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean", exclude_self: bool = True, family: HashFamily | None = None, probes: int = 1) -> DataFrame:
    """(q_id, id, dist): the k nearest points (id, v) of each query (q_id, v) and some more, ties to smaller ids, those of
    equal id left out if exclude_self. With a family only points that share a bucket, or one of the probed ones, in any table
    with the query. Vectors meet those of their own length; null ones take no part. Ids are longs."""
    if metric not in MEASURES:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(MEASURES)}")
    dim = len(family.a[0]) if family else None
    left = _packed(points.select(F.col("id").cast("long"), "v"), POINTS, family.buckets if family else None, dim)
    asked = _packed(queries.select(F.col("q_id").cast("long"), "v"), QUERIES, (lambda x: family.buckets(x, probes)) if family else None, dim)
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns])
    # Not an equation, by which all blocks of one length would be dealt to one task.
    both = left.join(asked, (F.col("dim") <= F.col("q_dim")) & (F.col("dim") >= F.col("q_dim")))

    def search(batches):
        held, ready = None, None
        so_far: dict[tuple, np.ndarray] = {}  # by block of queries, their k least distances in this task
        for batch in batches:
            for row in batch.to_pylist():
                if held != (row["dim"], row["block"], row["ids"]):
                    held, ready = (row["dim"], row["block"], row["ids"]), _Points(row, metric)
                q_ids = np.frombuffer(row["q_ids"], np.int64)
                q = np.frombuffer(row["q_data"], row["q_kind"]).reshape(len(q_ids), -1).astype(np.float64)
                best = so_far.setdefault((row["dim"], row["q_ids"]), np.full((len(q), k), np.inf))
                codes = None
                if family:
                    here = np.array([ready.keys.get(key, len(ready.keys)) for key in row["q_keys"]], np.int64)
                    codes = here[np.frombuffer(row["q_place"], np.int32).reshape(len(q), -1)]
                for at in range(0, len(q), STRIP):
                    part = slice(at, at + STRIP)
                    i, j, d = _strip(ready, q_ids[part], q[part], None if codes is None else codes[part], best[part], k, metric, exclude_self)
                    if len(i):
                        yield pa.record_batch([pa.array(q_ids[part][i]), pa.array(ready.ids[j]), pa.array(d)], ["q_id", "id", "dist"])

    return both.mapInArrow(search, "q_id long, id long, dist double")
