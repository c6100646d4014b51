"""Principal components, and training on compressed against full vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from . import kmeans, metrics
from .pq import rotation


def components(points: DataFrame, dim: int, count: int) -> np.ndarray:
    """The count directions of largest variance, from the covariance over all points."""
    return rotation(points, dim)[:count]


def projected(v: Column, directions: np.ndarray) -> Column:
    return F.transform(F.lit(directions.tolist()), lambda r: vectors.dot(v, r))


def compare_training(points: DataFrame, dim: int, clusters: int, count: int = 8, steps: int = 10, seed: int = 42) -> DataFrame:
    """(full_inertia, reduced_inertia, agreement): k-means on (id, v) and on its first components, both as mean distance in
    the space of their own, and the adjusted Rand index between both labellings."""
    small = points.select("id", projected(F.col("v"), components(points, dim, count)).alias("v"))
    labels, inertia = {}, {}
    for name, rows in (("full", points.select("id", "v")), ("reduced", small)):
        found = kmeans.assigned(rows, np.array(kmeans.lloyd(rows, clusters, steps, seed)))
        labels[name] = found.select("id", F.col("label").alias(name))
        inertia[name] = found.agg(F.avg("dist").alias(f"{name}_inertia"))
    agreement = metrics.adjusted_rand(labels["full"].join(labels["reduced"], "id"), "full", "reduced").withColumnRenamed("ari", "agreement")
    return inertia["full"].crossJoin(inertia["reduced"]).crossJoin(agreement)  # one row each
