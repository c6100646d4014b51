"""Product quantization: training, codes, distances on codes, compression, rotation, coarse cells, diffusion.

A codebook is (starts, lengths, centroids by subspace); it is as large as its parameters say, so it enters plans as a
literal or in a closure."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.hashing import order_key, uniform
from ..sources.scratch import drop, keep
from .kmeans import first_rows, lloyd


def nearest_divisor(dim: int, wanted: int) -> int:
    """The divisor of dim nearest to wanted, the smaller of two."""
    return min((d for d in range(1, dim + 1) if dim % d == 0), key=lambda d: (abs(d - wanted), d))


def splits(dim: int, subspaces: int, exact: bool = False) -> list[tuple[int, int]]:
    """(start, length) of each subspace: equal ones after changing their number to a divisor (exact), or the remainder
    spread over the first."""
    if exact:
        subspaces = nearest_divisor(dim, subspaces)
    base, more = divmod(dim, subspaces)
    sizes = [base + (k < more) for k in range(subspaces)]
    return [(sum(sizes[:k]), s) for k, s in enumerate(sizes)]


@dataclass(frozen=True)
class Codebook:
    splits: tuple[tuple[int, int], ...]
    centroids: tuple[tuple[tuple[float, ...], ...], ...]
    #: Rows are the directions that vectors are turned to before they are cut; None leaves them.
    rotation: tuple[tuple[float, ...], ...] | None = None

    @property
    def dim(self) -> int:
        return sum(n for _, n in self.splits)

    def turned(self, v: Column, back: bool = False) -> Column:
        if self.rotation is None:
            return v
        m = np.array(self.rotation)
        return F.transform(F.lit((m.T if back else m).tolist()), lambda r: vectors.dot(v, r))

    def _distances(self, turned: Column, m: int, squared: bool) -> Column:
        start, length = self.splits[m]
        measure = vectors.squared_l2 if squared else vectors.l2
        book = F.lit([list(c) for c in self.centroids[m]])
        return vectors.let(vectors.sub_vector(turned, start, length), lambda part: F.transform(book, lambda c: measure(part, c)))

    def distances(self, v: Column, m: int, squared: bool = False) -> Column:
        """Distances of a vector's part m to all centroids of subspace m."""
        return vectors.let(self.turned(v), lambda t: self._distances(t, m, squared))

    def encode(self, v: Column) -> Column:
        """The nearest centroid's number in each subspace, the smaller of two."""
        each = lambda t, m: vectors.let(self._distances(t, m, True), vectors.argmin)
        return vectors.let(self.turned(v), lambda t: F.array(*[each(t, m) for m in range(len(self.splits))]))

    def encode_arrow(self):
        """The same with one matrix product per subspace and Arrow batch."""
        books = [np.array(c) for c in self.centroids]
        turn = None if self.rotation is None else np.array(self.rotation).T

        @F.pandas_udf("array<int>")
        def encoded(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            x = np.stack(v.to_numpy()).astype(np.float64)
            x = x if turn is None else x @ turn
            codes = [np.argmin((c * c).sum(1) - 2 * x[:, s : s + n] @ c.T, axis=1) for (s, n), c in zip(self.splits, books, strict=True)]
            return pd.Series(list(np.stack(codes, axis=1).astype(np.int32)))

        return encoded

    def decode(self, code: Column) -> Column:
        """Centroids side by side; zeros for a code beyond its book."""

        def joined(own: Column) -> Column:
            books = [F.lit([list(c) for c in book]) for book in self.centroids]
            return F.concat(*[F.coalesce(F.get(b, F.get(own, m)), F.lit([0.0] * n)) for m, (b, (_, n)) in enumerate(zip(books, self.splits, strict=True))])

        return vectors.let(vectors.let(code, joined), lambda r: self.turned(r, back=True))

    def tables(self, q: Column, squared: bool = False) -> Column:
        """A query's distances to every centroid, by subspace."""
        return vectors.let(self.turned(q), lambda t: F.array(*[self._distances(t, m, squared) for m in range(len(self.splits))]))

    def ratio(self, n: int, bytes_each: int = 4, maps: list[list[int]] | None = None) -> float:
        """Bytes of n vectors over those of their codes, of the books and of the maps of a compressed one, four a number."""
        books = sum(len(c) * length * 4 for c, (_, length) in zip(self.centroids, self.splits, strict=True))
        return n * self.dim * bytes_each / (n * len(self.splits) * 4 + books + 4 * sum(map(len, maps or [])))

    def bit_ratio(self) -> float:
        """dim * 32 over subspaces * log2 centroids."""
        return self.dim * 32 / (len(self.splits) * math.log2(len(self.centroids[0])))

    def table(self, spark: SparkSession) -> DataFrame:
        """(subspace, code, centroid)."""
        rows = [(m, k, list(c)) for m, book in enumerate(self.centroids) for k, c in enumerate(book)]
        return spark.createDataFrame(rows, "subspace int, code int, centroid array<double>")

    def to_json(self) -> str:
        return json.dumps([self.splits, self.centroids, self.rotation])

    @classmethod
    def from_json(cls, text: str) -> Codebook:
        a, b, c = json.loads(text)
        return cls(tuple(map(tuple, a)), tuple(tuple(map(tuple, book)) for book in b), None if c is None else tuple(map(tuple, c)))


def hash_ratio(dim: int, tables: int, hashes: int) -> float:
    """Bits of a vector of 32-bit numbers over those of its hashes, a bit each."""
    return 32 * dim / (tables * hashes)


def turned_points(points: DataFrame, rotation: np.ndarray) -> DataFrame:
    """The points with v turned to the rotation's rows, a matrix product an Arrow batch."""
    matrix = np.asarray(rotation, float).T

    @F.pandas_udf("array<double>")
    def turned(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(v.to_numpy()).astype(np.float64) @ matrix), dtype=object) if len(v) else pd.Series([], dtype=object)

    return points.withColumn("v", turned("v"))


def _moved(points: DataFrame, book: Codebook) -> list[np.ndarray]:
    """The mean part of each centroid's points, in all subspaces by one aggregation; the old centroid where it has none."""
    width = max(n for _, n in book.splits)
    part = lambda t, m: F.struct(F.lit(m).alias("m"), vectors.let(book._distances(t, m, True), vectors.argmin).alias("code"), vectors.sub_vector(t, *book.splits[m]).alias("x"))
    parts = points.select(F.explode(vectors.let(book.turned(F.col("v")), lambda t: F.array(*[part(t, m) for m in range(len(book.splits))]))).alias("p")).select("p.*")
    new = [np.array(c, float) for c in book.centroids]
    for r in parts.groupBy("m", "code").agg(*[F.avg(F.get("x", F.lit(i))).alias(f"a{i}") for i in range(width)]).collect():  # a row a centroid
        new[r.m][r.code] = [r[f"a{i}"] for i in range(book.splits[r.m][1])]
    return new


def train(points: DataFrame, dim: int, subspaces: int = 8, centroids: int = 256, steps: int = 5, seed: int = 42, exact: bool = True, rotation: np.ndarray | None = None) -> Codebook:
    """Lloyd steps in all subspaces at once from the hash-first rows (id, v)."""
    cut = tuple(splits(dim, subspaces, exact))
    if rotation is not None:  # turned once, not in each step
        points = keep(turned_points(points.select("id", "v"), rotation), "turned")
    start = first_rows(points, centroids, seed)
    listed = lambda books: tuple(tuple(map(tuple, c.tolist())) for c in books)
    book = Codebook(cut, listed([start[:, s : s + n] for s, n in cut]))
    for _ in range(steps):
        new = listed(_moved(points, book))
        if new == book.centroids:
            break
        book = replace(book, centroids=new)
    if rotation is not None:
        drop(points)
        book = replace(book, rotation=tuple(map(tuple, np.asarray(rotation, float).tolist())))
    return book


def rotation(points: DataFrame, dim: int) -> np.ndarray:
    """Directions of largest variance first, from the covariance over all points, computed as sums."""
    from .estimators import covariance

    m = np.zeros((dim, dim))
    for r in covariance(points).collect():  # dim * (dim + 1) / 2 rows
        m[r.i, r.j] = m[r.j, r.i] = r["cov"] or 0.0
    values, directions = np.linalg.eigh(m)
    return directions[:, np.argsort(-values)].T


def summed_distance(tables: Column, code: Column, squared: bool = False) -> Column:
    """Over the subspaces, the sum of distances, or the root of the sum of squared ones, from a query's tables."""
    each = F.transform(code, lambda c, m: tables[m][c])
    return F.sqrt(vectors.total(each)) if squared else vectors.total(each)


def search(codes: DataFrame, queries: DataFrame, book: Codebook, k: int = 10, squared: bool = True, exclude_self: bool = True) -> DataFrame:
    """(q_id, rn, id, dist) by distances of queries to codes (id, pq_code): every pair, in blocks. A query's distances to
    all centroids are reckoned once a block and looked up by code."""
    from .ann import ranked
    from .blocks import searched

    books = [np.array(c, float) for c in book.centroids]
    turn = None if book.rotation is None else np.array(book.rotation).T

    def far(q, x):
        own, places = q if turn is None else q @ turn, x.astype(np.int64)
        for one in own:
            tables = [((c - one[s : s + n]) ** 2).sum(1) for (s, n), c in zip(book.splits, books, strict=True)]
            total = sum((t if squared else np.sqrt(t))[places[:, m]] for m, t in enumerate(tables))
            yield np.sqrt(total) if squared else total

    points = codes.select("id", F.col("pq_code").cast("array<double>").alias("v"))
    return ranked(searched(queries.select(F.col("q_id").alias("id"), "v"), points, far, k, exclude_self), k)


def rerank_codes(found: DataFrame, codes: DataFrame, queries: DataFrame, book: Codebook, k: int, metric: str = "euclidean") -> DataFrame:
    """Second stage of hash-then-quantize search: candidates (q_id, id) by the distance of both codes' centroids."""
    from .ann import ranked

    asked = queries.select("q_id", book.decode(book.encode(F.col("v"))).alias("q"))
    pairs = found.join(codes.select("id", book.decode(F.col("pq_code")).alias("v")), "id").join(asked, "q_id")
    return ranked(pairs.select("q_id", "id", vectors.distance(metric)(F.col("q"), F.col("v")).alias("dist")), k)


def code_stats(codes: DataFrame) -> DataFrame:
    """(subspace, code, count)."""
    return codes.select(F.posexplode("pq_code").alias("subspace", "code")).groupBy("subspace", "code").agg(F.count("*").alias("count"))


def code_importance(codes: DataFrame, book: Codebook) -> DataFrame:
    """(subspace, code, importance): the part of all points, 0 for unused codes."""
    spark = codes.sparkSession
    n = codes.agg(F.count("*").alias("n"))
    used = book.table(spark).select("subspace", "code").join(code_stats(codes), ["subspace", "code"], "left")
    return used.crossJoin(F.broadcast(n)).select("subspace", "code", (F.coalesce("count", F.lit(0)) / F.col("n")).alias("importance"))  # one number


def reconstruction_error(points: DataFrame, book: Codebook) -> DataFrame:
    """(mse_row, mse_element): mean squared distance per row and per number. Turning keeps distances, so with a rotation
    they are measured among the turned vectors."""
    if book.rotation is not None:
        points, book = turned_points(points, np.array(book.rotation)), replace(book, rotation=None)
    v = F.col("v")
    return points.agg(F.avg(vectors.squared_l2(v, book.decode(book.encode(v)))).alias("mse_row")).withColumn("mse_element", F.col("mse_row") / book.dim)


def distance_preservation(points: DataFrame, book: Codebook, reach: int = 10) -> DataFrame:
    """(correlation, mape) of pair distances before and after, for pairs of ids less than reach apart."""
    v = F.col("v")
    both = points.select("id", v, book.decode(book.encode(v)).alias("r"))
    left = both.select(F.col("id").alias("i"), F.col("v").alias("v1"), F.col("r").alias("r1"), F.explode(F.sequence(F.col("id") + 1, F.col("id") + reach - 1)).alias("id"))
    pairs = left.join(both, "id").select(vectors.l2(F.col("v1"), F.col("v")).alias("d"), vectors.l2(F.col("r1"), F.col("r")).alias("e"))
    return pairs.agg(F.corr("d", "e").alias("correlation"), F.avg(F.abs(F.col("d") - F.col("e")) / (F.col("d") + 1e-10)).alias("mape"))


def calibrate(points: DataFrame, book: Codebook, epochs: int = 1, rate: float = 0.1) -> Codebook:
    """Move each centroid by rate towards the mean of its points, epoch by epoch."""
    for _ in range(epochs):
        old = [np.array(c, float) for c in book.centroids]
        moved = [o - rate * (o - n) for o, n in zip(old, _moved(points, book), strict=True)]
        book = replace(book, centroids=tuple(tuple(map(tuple, c.tolist())) for c in moved))
    return book


def compressed(book: Codebook, importance: dict[tuple[int, int], float], threshold: float, least: int) -> tuple[Codebook, list[list[int]]]:
    """A smaller book and, by subspace, where each old code goes: codes by falling importance are kept, the first least
    of them always, later ones if farther than threshold from all kept; others go to the nearest kept."""
    books, maps = [], []
    for m, centroids in enumerate(book.centroids):
        c = np.array(centroids)
        order = sorted(range(len(c)), key=lambda k: (-importance.get((m, k), 0.0), k))
        kept: list[int] = []
        goes = [0] * len(c)
        for k in order:
            d = np.linalg.norm(c[kept] - c[k], axis=1) if kept else np.array([np.inf])
            if len(kept) < least or d.min() > threshold:
                goes[k] = len(kept)
                kept.append(k)
            else:
                goes[k] = int(np.argmin(d))
        books.append(tuple(tuple(centroids[k]) for k in kept))
        maps.append(goes)
    return replace(book, centroids=tuple(books)), maps


def mapped(code: Column, maps: list[list[int]]) -> Column:
    """Codes of the old book as codes of the compressed one."""
    return F.transform(code, lambda c, m: F.lit(maps)[m][c])


def coarse_cells(points: DataFrame, cells: int, steps: int = 5, seed: int = 42) -> tuple[np.ndarray, DataFrame]:
    """Centres of coarse cells and (id, cell) of every point."""
    from .kmeans import assigned

    centres = np.array(lloyd(points, cells, steps, seed))
    return centres, assigned(points, centres).select("id", F.col("label").alias("cell"))


def _near_cells(queries: DataFrame, centres: np.ndarray, n_probe: int, *columns: Column | str) -> DataFrame:
    far = F.transform(F.lit(centres.tolist()), lambda c, i: F.struct(vectors.squared_l2(F.col("v"), c).alias("d"), i.alias("cell")))
    asked = queries.select("q_id", *columns, F.explode(F.slice(F.array_sort(far), 1, n_probe)).alias("near"))
    return asked.withColumn("cell", F.col("near.cell")).drop("near")


def cell_search(points: DataFrame, codes: DataFrame, queries: DataFrame, book: Codebook, centres: np.ndarray, n_probe: int = 2, k: int = 10) -> DataFrame:
    """Distances to codes only in each query's n_probe nearest cells; codes are (id, cell, pq_code)."""
    from .ann import ranked

    pairs = _near_cells(queries, centres, n_probe, book.tables(F.col("v"), True).alias("tables")).join(codes, "cell").where("q_id <> id")
    return ranked(pairs.select("q_id", "id", summed_distance(F.col("tables"), F.col("pq_code"), True).alias("dist")), k)


def cell_search_exact(points: DataFrame, queries: DataFrame, centres: np.ndarray, n_probe: int = 2, k: int = 10) -> DataFrame:
    """Distances to the vectors in each query's n_probe nearest cells; points are (id, v, cell)."""
    from .ann import ranked

    pairs = _near_cells(queries, centres, n_probe, F.col("v").alias("q")).join(points.select("id", "v", "cell"), "cell").where("q_id <> id")
    return ranked(pairs.select("q_id", "id", vectors.l2(F.col("q"), F.col("v")).alias("dist")), k)


def synthetic(spark: SparkSession, book: Codebook, rows: int, noise: float = 0.1, seed: int = 42) -> DataFrame:
    """(id, pq_code, v): codes drawn by hash for each row and subspace, centroids and normal noise, turned back."""
    sizes = [len(c) for c in book.centroids]
    code = F.array(*[F.floor(uniform(f"{seed}-{m}", F.col("id")) * n).cast("int") for m, n in enumerate(sizes)])
    out = spark.range(rows).select("id", code.alias("pq_code"))
    out = out.withColumn("v", book.decode(F.col("pq_code")))
    if noise:
        wobble = F.array(*[F.randn(seed + i) * noise for i in range(book.dim)])
        out = out.withColumn("w", wobble).withColumn("v", F.zip_with("v", "w", lambda x, y: x + y)).drop("w")
    return out


@dataclass(frozen=True)
class DiffusionMap:
    """Landmarks, their map and eigenvalues; a bounded number of landmarks is held on the driver."""

    landmarks: np.ndarray
    coordinates: np.ndarray
    values: np.ndarray
    gamma: float

    @classmethod
    def fit(cls, points: DataFrame, components: int = 2, gamma: float = 1.0, alpha: float = 0.5, landmarks: int = 1000, seed: int = 42) -> DiffusionMap:
        """RBF affinity with rows of sum one, its product with its transpose again so, largest eigenpairs by value."""
        found = points.orderBy(order_key(seed, F.col("id")), "id").limit(landmarks).select("v").collect()
        x = np.array([r.v for r in found])
        a = cls._affinity(x, x, gamma)
        a = a.T @ a
        a /= a.sum(1, keepdims=True)
        values, directions = np.linalg.eig(a)
        order = np.argsort(-values.real)[:components]
        values = np.maximum(values.real[order], 1e-12)
        return cls(x, directions.real[:, order] * values**alpha, values, gamma)

    def to_json(self) -> str:
        return json.dumps([self.landmarks.tolist(), self.coordinates.tolist(), self.values.tolist(), self.gamma])

    @classmethod
    def from_json(cls, text: str) -> DiffusionMap:
        landmarks, coordinates, values, gamma = json.loads(text)
        return cls(np.array(landmarks), np.array(coordinates), np.array(values), gamma)

    @staticmethod
    def _affinity(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
        d = np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0)
        a = np.exp(-gamma * d)
        return a / np.maximum(a.sum(1, keepdims=True), 1e-300)

    def extend(self):
        """Nystroem extension as an Arrow function of vectors."""

        @F.pandas_udf("array<double>")
        def mapped_to(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            return pd.Series(list(self._affinity(np.stack(v.to_numpy()).astype(np.float64), self.landmarks, self.gamma) @ self.coordinates / self.values))

        return mapped_to

    def pre_image(self, neighbours: int = 5):
        """Back to vectors: the mean of the nearest landmarks in the map, weighted by inverse distance."""

        @F.pandas_udf("array<double>")
        def back(m: pd.Series) -> pd.Series:
            out = []
            for p in m:
                d = np.linalg.norm(self.coordinates - np.asarray(p), axis=1)
                near = np.argsort(d, kind="stable")[:neighbours]
                w = 1 / (d[near] + 1e-10)
                out.append(w @ self.landmarks[near] / w.sum())
            return pd.Series(out, dtype=object)

        return back
