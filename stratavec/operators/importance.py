"""Importance sampling by codes of a product quantizer: importances of codes, quotas or odds, draws with weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..sources.scratch import keep
from . import sampling
from .kmeans import means
from .pq import Codebook

#: Over a code's size, the variances vr of its points' distances and vf of the target, and their mean distance spread:
#: odds in all subspaces. Small variances are lifted and large ones bounded by the size.
CODE_IMPORTANCE = {
    "proportional": lambda: F.col("size").cast("double"),
    "residual_variance": lambda: F.least(F.greatest(F.sqrt(F.greatest("vr", F.lit(1e-6)) * F.greatest("vf", F.lit(1e-6))) * F.col("size"), F.lit(1e-6)), 10.0 * F.col("size")),
    "cluster_density": lambda: F.col("size") / (1 + F.col("spread")),
    "target_variance": lambda: F.least(F.greatest(F.col("vf") * F.col("size"), F.lit(1e-6)), 10.0 * F.col("size")),
}


def code_strata(points: DataFrame, book: Codebook, target: Column, strategy: str) -> tuple[DataFrame, DataFrame]:
    """(id, subspace, code), (subspace, code, size, importance) of points (id, v)."""
    if strategy not in CODE_IMPORTANCE:
        raise ValueError(f"unknown strategy {strategy!r}; one of {', '.join(CODE_IMPORTANCE)}")
    parts = points.withColumn("f", target)
    each = F.array(*[F.struct(F.lit(m).alias("subspace"), vectors.argmin(book.distances(F.col("v"), m, True)).alias("code"), F.array_min(book.distances(F.col("v"), m)).alias("dist")) for m in range(len(book.splits))])
    codes = keep(parts.select("id", "f", F.explode(each).alias("s")).select("id", "f", "s.*"), "codes")
    stats = codes.groupBy("subspace", "code").agg(F.count("*").alias("size"), F.avg("dist").alias("spread"), F.coalesce(F.var_samp("dist"), F.lit(0.0)).alias("vr"), F.coalesce(F.var_samp("f"), F.lit(0.0)).alias("vf"))
    return codes.select("id", "subspace", "code"), stats.withColumn("importance", CODE_IMPORTANCE[strategy]()).select("subspace", "code", "size", "importance")


def odds(points: DataFrame, book: Codebook, target: Column, strategy: str = "proportional", temperature: float = 1.0) -> DataFrame:
    """(id, q): odds of each point by its codes in all subspaces."""
    return sampling.point_probabilities(*code_strata(points, book, target, strategy), temperature)


def first_subspace_sample(points: DataFrame, book: Codebook, target: Column, total: int, strategy: str = "proportional", temperature: float = 1.0, seed: int = 42) -> DataFrame:
    """(id, code, weight) by the codes of the first subspace alone: quotas are the rounded-down shares of a softmax over
    the codes' importances, given out by falling odds and not topped up; weights are 1 / (p x n / size x N). Importances are
    the size; the variance of distances to the centroid, times that of the target, times the size (the size for one point);
    or the size over one more than the mean distance to the points' own mean."""
    start, length = book.splits[0]
    far = book.distances(F.col("v"), 0)
    rows = points.select("id", "v", target.alias("f"), vectors.argmin(book.distances(F.col("v"), 0, True)).alias("label"), F.array_min(far).alias("dist"))
    rows = keep(rows, "codes")
    stats = rows.groupBy("label").agg(F.count("*").alias("size"), F.var_samp("dist").alias("vr"), F.var_samp("f").alias("vf"))
    if strategy == "proportional":
        value = F.col("size").cast("double")
    elif strategy == "residual_variance":
        value = F.when(F.col("size") < 2, F.col("size").cast("double")).otherwise(F.col("vr") * F.col("vf") * F.col("size"))
    elif strategy == "cluster_density":
        centre, _ = means(rows, np.zeros((len(book.centroids[0]), book.dim)))
        own = vectors.l2(F.col("v"), F.get(F.lit(centre.tolist()), F.col("label")))
        stats = stats.join(rows.groupBy("label").agg(F.avg(own).alias("spread")), "label")
        value = F.col("size") / (1 + F.col("spread"))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    strata = keep(stats.withColumn("importance", F.greatest(F.coalesce(value, F.lit(1.0)), F.lit(0.0))).withColumnRenamed("label", "code").select("code", "size", "importance"), "strata")
    if (strata.agg(F.sum("importance")).first()[0] or 0.0) == 0.0:
        strata = strata.withColumn("importance", F.lit(1.0))
    n = F.broadcast(strata.agg(F.sum("size").alias("all")))  # one number
    quotas = sampling.greedy_quotas(sampling.softmax(strata, "importance", temperature), "code", total, rounding="floor").crossJoin(n)
    found = sampling.drawn(rows.select("id", F.col("label").alias("code")), quotas.select("code", "size", "n", "p", "all"), ["code"], seed)
    point = F.col("p") * F.col("n") / F.col("size")
    return found.select("id", "code", F.coalesce(1 / F.when(point > 0, point * F.col("all")), F.lit(1.0)).alias("weight"))
