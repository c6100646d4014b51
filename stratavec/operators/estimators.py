"""Estimates from weighted samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import keep


def expectation(sample: DataFrame, target: Column, weight: str = "weight") -> DataFrame:
    """(expectation): the weighted mean."""
    w = F.col(weight)
    return sample.agg((F.sum(w * target) / F.sum(w)).alias("expectation"))


def variance(sample: DataFrame, target: Column, weight: str = "weight") -> DataFrame:
    """(variance): the weighted mean of squares off the weighted mean, in two passes."""
    w = F.col(weight)
    mean = sample.agg((F.sum(w * target) / F.sum(w)).alias("mu"))
    return sample.crossJoin(F.broadcast(mean)).agg((F.sum(w * F.pow(target - F.col("mu"), 2)) / F.sum(w)).alias("variance"))  # one number


def effective_size(sample: DataFrame, weight: str = "weight") -> DataFrame:
    """(ess): squared sum over sum of squares."""
    w = F.col(weight)
    return sample.agg((F.pow(F.sum(w), 2) / F.sum(w * w)).alias("ess"))


def component_means(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """(pos, mean) of vectors v."""
    w = weight if weight is not None else F.lit(1.0)
    parts = rows.select(w.alias("w"), F.posexplode("v").alias("pos", "x"))
    return parts.groupBy("pos").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean"))


def covariance(rows: DataFrame) -> DataFrame:
    """(i, j, cov) of the components of v, i <= j: each task adds up one matrix product a batch, of vectors less their mean,
    and sends a row a pair of components."""

    def mean(batches):
        n, s = 0, None
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_numpy()).astype(np.float64)
                n, s = n + len(x), x.sum(0) + (0 if s is None else s)
        if n:
            yield pd.DataFrame({"i": np.arange(len(s), dtype=np.int32), "s": s, "n": n})

    sums = rows.select("v").mapInPandas(mean, "i int, s double, n long").groupBy("i").agg((F.sum("s") / F.sum("n")).alias("m")).orderBy("i").collect()  # a row a component
    centre = np.array([r.m for r in sums])

    def products(batches):
        n, s, p = 0, np.zeros(len(centre)), np.zeros((len(centre), len(centre)))
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_numpy()).astype(np.float64) - centre
                n, s, p = n + len(x), s + x.sum(0), p + x.T @ x
        if n:
            i, j = np.triu_indices(len(centre))
            yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "n": n, "si": s[i], "sj": s[j], "p": p[i, j]})

    parts = rows.select("v").mapInPandas(products, "i int, j int, n long, si double, sj double, p double").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "p")])
    return parts.select("i", "j", ((F.col("p") - F.col("si") * F.col("sj") / F.col("n")) / F.when(F.col("n") > 1, F.col("n") - 1)).alias("cov"))


def compare(original: DataFrame, sampled: DataFrame, weight: Column | None = None) -> DataFrame:
    """(mean_diff, cov_diff): norms of the differences of means and of covariance matrices; the second is null for a
    weighted sample. The sample is written first, as it is read several times."""
    sampled = keep(sampled.withColumn("_w", weight) if weight is not None else sampled.select("v"), "sample")
    weight = weight if weight is None else F.col("_w")
    means = component_means(original).alias("a").join(component_means(sampled, weight).alias("b"), "pos")
    mean = means.agg(F.sqrt(F.sum(F.pow(F.col("a.mean") - F.col("b.mean"), 2))).alias("mean_diff"))
    if weight is not None:
        return mean.withColumn("cov_diff", F.lit(None).cast("double"))
    covs = covariance(original).alias("a").join(covariance(sampled).alias("b"), ["i", "j"])
    twice = F.when(F.col("i") == F.col("j"), 1).otherwise(2)
    cov = covs.agg(F.sqrt(F.sum(twice * F.pow(F.col("a.cov") - F.col("b.cov"), 2))).alias("cov_diff"))
    return mean.crossJoin(cov)  # one row each
