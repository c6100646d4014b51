"""K-means by gradient descent on losses of distances to the nearest centre.

Each step needs, for every cluster, the sum of the unit vectors from points to the centre: one aggregation of all
points. The optimizer's state is as large as the centres and lives on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.models import Stored
from .kmeans import assigned, first_rows, plus_plus


def losses(points: DataFrame, centres: np.ndarray, entropy: float = 0.1, repulsion: float = 0.1, reach: float = 1.0) -> DataFrame:
    """(standard, cluster_variance, entropy, repulsion): the mean distance; the mean of clusters' mean distances; the
    first less entropy times that of the cluster sizes; the first and repulsion times the mean of exp(-d / reach) over
    pairs of centres. All come from per-cluster sums."""
    by = assigned(points, centres).groupBy("label").agg(F.sum("dist").alias("s"), F.count("*").alias("n"))
    d = np.linalg.norm(centres[:, None] - centres[None], axis=2)
    push = float(np.exp(-d[~np.eye(len(d), dtype=bool)] / reach).mean()) if len(d) > 1 else 0.0
    parts = by.crossJoin(F.broadcast(by.agg(F.sum("n").alias("all")))).withColumn("p", F.col("n") / F.col("all"))  # one number
    out = parts.agg((F.sum("s") / F.sum("n")).alias("standard"), F.avg(F.col("s") / F.col("n")).alias("cluster_variance"), F.sum(-F.col("p") * F.log(F.col("p") + 1e-8)).alias("h"))
    return out.select("standard", "cluster_variance", (F.col("standard") - entropy * F.col("h")).alias("entropy"), (F.col("standard") + repulsion * push).alias("repulsion"))


def contrastive(points: DataFrame, centres: np.ndarray, temperature: float = 0.5, limit: int = 1000, seed: int = 42) -> float:
    """InfoNCE over pairs of one cluster, on a hash-chosen sample of at most limit points, as pairs grow with its square.
    It doesn't depend on the centres but through the labels, so it is a score and has no gradient."""
    rows = assigned(first_sample(points, limit, seed), centres).select("label", "v").collect()
    x, label = np.array([r.v for r in rows]), np.array([r.label for r in rows])
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    e = np.exp(x @ x.T / temperature)
    np.fill_diagonal(e, 0)
    same = (label[:, None] == label[None]) & ~np.eye(len(x), dtype=bool)
    some = same.any(1)
    return float(-np.log((e * same).sum(1)[some] / e.sum(1)[some]).mean()) if some.any() else 0.0


def first_sample(points: DataFrame, limit: int, seed: int) -> DataFrame:
    from .sampling import uniform_sample

    return uniform_sample(points, limit, seed)


def _gradient(labelled: DataFrame, k: int, dim: int, centres: np.ndarray, by_cluster: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean over all points of unit vectors from point to centre, by cluster; counts; the mean distance. With by_cluster
    means are taken over each cluster's points, then over the clusters that have some."""
    centre = F.get(F.lit(centres.tolist()), F.col("label"))
    unit = F.zip_with(centre, F.col("v"), lambda c, x: (c - x) / F.greatest(F.col("dist"), F.lit(1e-12)))
    rows = labelled.withColumn("u", unit).groupBy("label").agg(F.count("*").alias("n"), F.sum("dist").alias("s"), *[F.sum(F.col("u")[i]).alias(f"g{i}") for i in range(dim)]).collect()
    total = sum(r.n for r in rows)
    g, n = np.zeros((k, dim)), np.zeros(k, np.int64)
    for r in rows:  # a row a cluster
        g[r.label], n[r.label] = [r[f"g{i}"] for i in range(dim)], r.n
    if by_cluster:
        some = max(int((n > 0).sum()), 1)
        return g / np.maximum(n, 1)[:, None] / some, n, sum(r.s / r.n for r in rows) / some
    return g / max(total, 1), n, sum(r.s for r in rows) / max(total, 1)


@dataclass
class GradientKMeans(Stored):
    """loss is standard, the mean distance; cluster_variance, the mean of the clusters' mean distances; repulsion, standard
    and a term that drives centres apart; or entropy, standard less a weight times the entropy of the cluster sizes. Sizes
    don't change with small moves of the centres, so entropy has no gradient of its own: its steps are standard's, and
    only its history of losses, and so where it stops, differs."""

    k: int
    optimizer: str = "adam"
    rate: float = 0.01
    steps: int = 50
    decay_every: int = 20
    decay: float = 0.5
    clip: float = 1.0
    patience: int = 10
    tol: float = 1e-4
    loss: str = "standard"
    entropy: float = 0.1
    repulsion: float = 0.1
    reach: float = 1.0
    init: str = "hash"
    seed: int = 42
    centres: np.ndarray | None = None
    history: list[tuple[int, float, float, int]] = field(default_factory=list)
    sizes: list[list[int]] = field(default_factory=list)

    def __post_init__(self):
        if self.optimizer not in ("adam", "sgd", "rmsprop"):
            raise ValueError(f"unknown optimizer {self.optimizer!r}")
        if self.loss not in ("standard", "cluster_variance", "entropy", "repulsion"):
            raise ValueError(f"no gradient for loss {self.loss!r}")

    def _push(self) -> np.ndarray:
        """Gradient of the mean of exp(-d / reach) over pairs of centres."""
        c = self.centres
        away = c[:, None] - c[None]
        d = np.maximum(np.linalg.norm(away, axis=2), 1e-12)
        w = np.exp(-d / self.reach) / (self.reach * d)
        np.fill_diagonal(w, 0)
        return -2 * (w[:, :, None] * away).sum(1) / max(self.k * (self.k - 1), 1)

    def _refilled(self, points: DataFrame, empty: np.ndarray) -> None:
        """Each empty cluster's centre goes to one of the points farthest from theirs."""
        far = assigned(points, self.centres).orderBy(F.desc("dist"), "id").limit(len(empty)).collect()
        for k, r in zip(empty, far, strict=False):
            self.centres[k] = r.v

    def fit(self, points: DataFrame, steps: int | None = None) -> GradientKMeans:
        points = points.select("id", "v")
        if self.centres is None:
            self.centres = (plus_plus if self.init == "k-means++" else first_rows)(points, self.k, self.seed)
        first, second = np.zeros_like(self.centres), np.zeros_like(self.centres)
        best, waited = np.inf, 0
        for step in range(1, (steps or self.steps) + 1):
            g, n, loss = _gradient(assigned(points, self.centres), self.k, self.centres.shape[1], self.centres, self.loss == "cluster_variance")
            if self.loss == "repulsion":
                d = np.linalg.norm(self.centres[:, None] - self.centres[None], axis=2)[~np.eye(self.k, dtype=bool)]
                g, loss = g + self.repulsion * self._push(), loss + self.repulsion * float(np.exp(-d / self.reach).mean() if len(d) else 0.0)
            elif self.loss == "entropy":
                part = n / max(n.sum(), 1)
                loss += self.entropy * float((part * np.log(part + 1e-8)).sum())
            g *= min(1.0, self.clip / max(np.linalg.norm(g), 1e-12))
            rate = self.rate * self.decay ** ((step - 1) // self.decay_every)
            if self.optimizer == "adam":
                first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
                change = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            elif self.optimizer == "rmsprop":
                second = 0.99 * second + 0.01 * g * g
                change = rate * g / (np.sqrt(second) + 1e-8)
            else:
                change = rate * g
            self.centres = self.centres - change
            self.history.append((step, loss, float(np.abs(change).max()), int((n == 0).sum())))
            self.sizes.append(n.tolist())
            if (empty := np.flatnonzero(n == 0)).size:
                self._refilled(points, empty)
            waited = 0 if loss < best - self.tol else waited + 1
            best = min(best, loss)
            if waited >= self.patience:
                break
        return self

    def fit_incremental(self, chunk: DataFrame, epochs: int = 1, ratio: float = 0.1) -> GradientKMeans:
        """A few steps on new points at a part of the rate."""
        rate, self.rate = self.rate, self.rate * ratio
        try:
            return self.fit(chunk, epochs)
        finally:
            self.rate = rate

    def predict(self, points: DataFrame) -> DataFrame:
        return assigned(points, self.centres).drop("dist")

    def score(self, points: DataFrame) -> float:
        return assigned(points, self.centres).agg(F.avg("dist")).first()[0]

    def inertia(self, points: DataFrame, squared: bool = False) -> float:
        d: Column = F.col("dist")
        return assigned(points, self.centres).agg(F.sum(d * d if squared else d)).first()[0]

    def history_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.history, "step int, loss double, change double, empty int")
