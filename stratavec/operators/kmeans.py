"""K-means in Lloyd steps and incremental ones, K-modes, and their scores.

Centroids are a numpy array on the driver, as large as k says; each step is one aggregation of all points. Sums are
partial in every task before anything is shuffled, so a cluster of any size is no hot key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.hashing import order_key
from ..sources.models import Stored


def first_rows(points: DataFrame, k: int, seed: int = 42) -> np.ndarray:
    """k points chosen by hash order."""
    return np.array([list(r.v) for r in points.orderBy(order_key(seed, F.col("id")), "id").limit(k).select("v").collect()])


def plus_plus(points: DataFrame, k: int, seed: int = 42, sample: int = 5000) -> np.ndarray:
    """Centres drawn in proportion to the squared distance from those before, from at most sample hash-chosen points."""
    x, rng = first_rows(points, sample, seed), np.random.default_rng(seed)
    out = [x[0]]
    while len(out) < min(k, len(x)):
        d = np.min([((x - c) ** 2).sum(1) for c in out], axis=0)
        out.append(x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else len(out)])
    return np.array(out)


def nearest(v: Column, centres: np.ndarray, metric: str = "euclidean") -> Column:
    """(label, dist): the nearest centre, the first of equals."""
    measure = vectors.distance(metric)

    def first(found: Column) -> Column:
        least = F.array_min(found)
        return F.struct((F.array_position(found, least) - 1).cast("int").alias("label"), least.alias("dist"))

    return vectors.let(F.transform(F.lit(np.asarray(centres, float).tolist()), lambda c: measure(v, c)), first)


def assigned(points: DataFrame, centres: np.ndarray, metric: str = "euclidean") -> DataFrame:
    """Add label and dist."""
    return points.withColumn("_near", nearest(F.col("v"), centres, metric)).withColumns({"label": F.col("_near.label"), "dist": F.col("_near.dist")}).drop("_near")


def assigned_arrow(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """The label by one matrix product per Arrow batch."""
    c = np.asarray(centres, float)

    @F.pandas_udf("int")
    def label(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.zeros((0, c.shape[1]))
        return pd.Series(np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1).astype(np.int32))

    return points.withColumn("label", label("v"))


def means(labelled: DataFrame, old: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean vector and count of each label; an empty cluster keeps its old centre."""
    dim = old.shape[1]
    sums = [F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(dim)]
    new, count = old.astype(float).copy(), np.zeros(len(old), np.int64)
    for r in labelled.groupBy("label").agg(F.count("*").alias("n"), *sums).collect():  # a row a cluster
        new[r.label], count[r.label] = [r[f"m{i}"] for i in range(dim)], r.n
    return new, count


def lloyd(points: DataFrame, k: int, steps: int = 5, seed: int = 42, init: np.ndarray | None = None, tol: float = 0.0, history: list | None = None) -> list[list[float]]:
    """Centres after that many steps, or once none moves more than tol; each step's move goes to history."""
    centres = first_rows(points, k, seed) if init is None else np.asarray(init, float)
    for step in range(steps):
        new, _ = means(assigned(points, centres), centres)
        moved = float(np.abs(new - centres).max(initial=0))
        if history is not None:
            history.append([step + 1, moved])
        centres = new
        if moved <= tol:
            break
    return centres.tolist()


def valid(points: DataFrame, dim: int | None = None) -> DataFrame:
    """The points (.., v) whose numbers are all finite, and of the given number."""
    whole = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return points.where(F.coalesce(whole if dim is None else whole & (F.size("v") == dim), F.lit(False)))


def valid_centres(centres: list, dim: int, old: np.ndarray) -> np.ndarray:
    """The centres with dim finite numbers; the old ones if there is none."""
    found = [c for c in (np.asarray(c, float) for c in centres) if c.shape == (dim,) and np.isfinite(c).all()]
    return np.array(found) if found else old


def diverse(centres: np.ndarray, count: int, seed: int = 42) -> np.ndarray:
    """count of the centres, each next one farthest from those before; all, if there aren't more. The first by seed."""
    centres = np.asarray(centres, float)
    if len(centres) <= count:
        return centres
    chosen = [int(np.random.default_rng(seed).integers(len(centres)))]
    near = np.linalg.norm(centres - centres[chosen[0]], axis=1)
    while len(chosen) < count:
        near[chosen] = -1.0
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, np.linalg.norm(centres - centres[chosen[-1]], axis=1))
    return centres[chosen]


def chunks(points: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """Add chunk: parts of about size rows each in hash order, for one partial fit after the other."""
    count = max(1, -(-points.count() // size))
    return points.withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(count)).cast("int"))


def sized(points: DataFrame, dim: int, megabytes: float = 128.0, most: int = 1000) -> DataFrame:
    """The points in partitions of about that many megabytes, at most ten a core; as they are where that changes their
    number by less than a third."""
    spark = points.sparkSession
    wanted = min(max(1, int(points.count() * dim * 8 / 2**20 / megabytes)), min(spark.sparkContext.defaultParallelism * 10, most))
    now = points.rdd.getNumPartitions()
    return points.repartition(wanted) if abs(now - wanted) > 0.3 * now else points


class KMeans(Stored):
    """fit, transform, partial_fit; standardized by the population deviation where asked for."""

    def __init__(self, k: int, steps: int = 20, seed: int = 42, tol: float = 1e-4, init: str = "hash", standardize: bool = False):
        self.k, self.steps, self.seed, self.tol, self.init, self.standardize = k, steps, seed, tol, init, standardize
        self.centres: np.ndarray | None = None
        self.counts: np.ndarray | None = None
        self.history: list[list[float]] = []

    def fit(self, points: DataFrame) -> KMeans:
        work = valid(points.select("id", "v"))
        if self.standardize:
            scale = Scale.fit(work)
            work = work.withColumn("v", scale.apply(F.col("v")))
        start = plus_plus(work, self.k, self.seed) if self.init == "k-means++" else first_rows(work, self.k, self.seed)
        self.history = []
        centres = np.array(lloyd(work, self.k, self.steps, self.seed, start, self.tol, self.history))
        _, self.counts = means(assigned(work, centres), centres)
        self.centres = scale.undo(centres) if self.standardize else centres
        return self

    def transform(self, points: DataFrame, arrow: bool = False) -> DataFrame:
        return assigned_arrow(points, self.centres) if arrow else assigned(points, self.centres).drop("dist")

    def fit_transform(self, points: DataFrame) -> DataFrame:
        return self.fit(points).transform(points)

    def partial_fit(self, points: DataFrame, rate: float | None = None) -> KMeans:
        """Running means: a cluster moves towards its new points' mean by their part of all its points, or by rate."""
        points = valid(points)
        if self.centres is None:
            self.centres, self.counts = first_rows(points, self.k, self.seed), np.zeros(self.k, np.int64)
        new, count = means(assigned(points, self.centres), self.centres)
        part = np.where(count > 0, rate if rate is not None else count / np.maximum(self.counts + count, 1), 0.0)
        self.centres = self.centres + part[:, None] * (new - self.centres)
        self.counts = self.counts + count
        return self

    def history_frame(self, spark) -> DataFrame:
        """(step, change): the largest move of a centre's component in each Lloyd step."""
        return spark.createDataFrame([(int(s), float(c)) for s, c in self.history], "step int, change double")


class Scale:
    """Mean and population deviation by component; a deviation of 0 counts as 1."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        self.mean, self.deviation = mean, deviation

    @classmethod
    def fit(cls, points: DataFrame) -> Scale:
        rows = points.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()
        s = np.array([r.s for r in rows])
        return cls(np.array([r.m for r in rows]), np.where(s == 0, 1.0, s))

    def apply(self, v: Column) -> Column:
        centred = F.zip_with(v, F.lit(self.mean.tolist()), lambda x, m: x - m)
        return F.zip_with(centred, F.lit(self.deviation.tolist()), lambda x, s: x / s)

    def undo(self, centres: np.ndarray) -> np.ndarray:
        return centres * self.deviation + self.mean


def modes(labelled: DataFrame, old: list[list]) -> list[list]:
    """Most frequent value of each place of v by label, the smallest of equals; an empty cluster keeps its mode."""
    parts = labelled.select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos", "x").agg(F.count("*").alias("n"))
    best = parts.groupBy("label", "pos").agg(F.min_by("x", F.struct(-F.col("n"), F.col("x"))).alias("x"))
    out = [list(m) for m in old]
    for r in best.collect():  # a row a cluster and place
        out[r.label][r.pos] = r.x
    return out


class KModes(Stored):
    """K-means for categories: the Hamming distance and component-wise modes. init is hash, or ++: modes drawn in proportion
    to the distance from those before, from at most sample hash-chosen distinct rows. refill moves an empty cluster's mode
    to a row farthest from its own."""

    def __init__(self, k: int, steps: int = 20, seed: int = 42, init: str = "hash", refill: bool = True, sample: int = 5000):
        if init not in ("hash", "++"):
            raise ValueError(f"unknown init {init!r}")
        self.k, self.steps, self.seed, self.init, self.refill, self.sample = k, steps, seed, init, refill, sample
        self.modes: list[list] | None = None
        self.history: list[float] = []
        self.sizes: list[list[int]] = []

    def assigned(self, points: DataFrame) -> DataFrame:
        found = F.transform(F.lit(self.modes), lambda m: vectors.hamming(F.col("v"), m))
        least = F.array_min(found)
        return points.withColumns({"label": (F.array_position(found, least) - 1).cast("int"), "dist": least})

    def _start(self, points: DataFrame) -> list[list]:
        distinct = points.groupBy("v").agg(F.min("id").alias("id")).orderBy(order_key(self.seed, F.col("id")), "id")
        rows = [list(r.v) for r in distinct.limit(self.k if self.init == "hash" else self.sample).collect()]
        if self.init == "hash":
            return rows
        x, rng = np.array(rows, object), np.random.default_rng(self.seed)
        out = [0]
        while len(out) < min(self.k, len(x)):
            d = np.min([(x != x[i]).mean(1) for i in out], axis=0)
            out.append(int(rng.choice(len(x), p=d / d.sum())))
        return [rows[i] for i in out]

    def fit(self, points: DataFrame) -> KModes:
        self.modes, self.history, self.sizes = self._start(points), [], []
        for _ in range(self.steps):
            rows = self.assigned(points)
            by = {r.label: r for r in rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("dist").alias("s")).collect()}  # a row a cluster
            self.history.append(sum(r.s for r in by.values()) / max(sum(r.n for r in by.values()), 1))
            self.sizes.append([by[k].n if k in by else 0 for k in range(len(self.modes))])
            new = modes(rows, self.modes)
            empty = [k for k in range(len(new)) if k not in by]
            if empty and self.refill:
                for k, r in zip(empty, rows.where("dist > 0").orderBy(F.desc("dist"), "id").limit(len(empty)).collect(), strict=False):
                    new[k] = list(r.v)
            if new == self.modes:
                break
            self.modes = new
        return self

    def fit_incremental(self, chunk: DataFrame, before: DataFrame | None = None) -> KModes:
        """Modes have no running form: a fit on the chunk, with the rows before where they are given."""
        return self.fit(chunk if before is None else before.select("id", "v").unionByName(chunk.select("id", "v")))

    def predict(self, points: DataFrame) -> DataFrame:
        return self.assigned(points).drop("dist")

    def score(self, points: DataFrame) -> float:
        return self.assigned(points).agg(F.avg("dist")).first()[0]

    def history_frame(self, spark) -> DataFrame:
        """(step, loss, empty)."""
        return spark.createDataFrame([(k + 1, float(x), sum(n == 0 for n in sizes)) for k, (x, sizes) in enumerate(zip(self.history, self.sizes, strict=True))], "step int, loss double, empty int")
