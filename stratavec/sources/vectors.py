"""Vector sources and sinks: Parquet with packed or wide columns, JSON batches, generated data, JDBC."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.hashing import uniform


def read_packed(spark: SparkSession, path: str, id_: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v) of a Parquet table with one array column; other columns are not read."""
    return spark.read.parquet(path).select(F.col(id_).alias("id"), vectors.doubles(column).alias("v"))


def read_wide(spark: SparkSession, path: str, prefix: str = "emb_", label: str | None = "label") -> DataFrame:
    """(v, label) of a Parquet table with a column for each number, named prefix and place."""
    table = spark.read.parquet(path)
    numbered = sorted((int(m[1]), c) for c in table.columns if (m := re.fullmatch(re.escape(prefix) + r"(\d+)", c)))
    if not numbered:
        raise ValueError(f"no column begins with {prefix!r}")
    return table.select(vectors.pack(*[c for _, c in numbered]).alias("v"), *([label] if label in table.columns else []))


def write_wide(points: DataFrame, path: str, dim: int, prefix: str = "emb_", label: str | None = None) -> None:
    points.select(*[F.col("v")[i].alias(f"{prefix}{i}") for i in range(dim)], *([label] if label else [])).write.parquet(path)


def read_json_batches(spark: SparkSession, path: str) -> DataFrame:
    """(dataset_name, batch_id, pos, v) of requests {dataset_name, batch_id, data: [[...]]}, a line each."""
    requests = spark.read.schema("dataset_name string, batch_id string, data array<array<float>>").json(path)
    return requests.select("dataset_name", "batch_id", F.posexplode("data").alias("pos", "v"))


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database whose driver is on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def checked(points: DataFrame, dim: int) -> DataFrame:
    """The points, failing the query at a vector of another length."""
    wrong = F.concat(F.lit(f"expected {dim} numbers, found "), F.size("v").cast("string"))
    return points.withColumn("v", F.when(F.size("v") == dim, F.col("v")).otherwise(F.raise_error(wrong).cast("array<double>")))


def _normal(seed: str, key) -> F.Column:
    """A normal number fixed by seed and key."""
    return F.sqrt(-2 * F.log(1 - uniform(seed + "a", key))) * F.cos(2 * math.pi * uniform(seed + "b", key))


def blobs(spark: SparkSession, rows: int, dim: int = 2, centres: int = 3, spread: float = 1.0, box: float = 10.0, seed: int = 42) -> DataFrame:
    """(id, v, label): normal clouds around hash-chosen centres."""
    label = F.pmod(F.col("id"), F.lit(centres)).cast("int")
    numbers = [box * (2 * uniform(f"{seed}c{i}", F.col("label")) - 1) + spread * _normal(f"{seed}n{i}", F.col("id")) for i in range(dim)]
    return spark.range(rows).withColumn("label", label).select("id", F.array(*numbers).alias("v"), "label")


def circles(spark: SparkSession, rows: int, noise: float = 0.05, factor: float = 0.5, extra: int = 0, seed: int = 42) -> DataFrame:
    """(id, v, label): two rings, and extra numbers of noise."""
    label = F.pmod(F.col("id"), F.lit(2)).cast("int")
    size = F.when(label == 0, 1.0).otherwise(factor)
    angle = 2 * math.pi * uniform(f"{seed}t", F.col("id"))
    numbers = [size * F.cos(angle) + noise * _normal(f"{seed}x", F.col("id")), size * F.sin(angle) + noise * _normal(f"{seed}y", F.col("id"))]
    return spark.range(rows).select("id", F.array(*numbers, *[_normal(f"{seed}e{i}", F.col("id")) for i in range(extra)]).alias("v"), label.alias("label"))


def moons(spark: SparkSession, rows: int, noise: float = 0.1, extra: int = 0, seed: int = 42) -> DataFrame:
    """(id, v, label): two half circles that interlock."""
    label = F.pmod(F.col("id"), F.lit(2)).cast("int")
    angle = math.pi * uniform(f"{seed}t", F.col("id"))
    x = F.when(label == 0, F.cos(angle)).otherwise(1 - F.cos(angle)) + noise * _normal(f"{seed}x", F.col("id"))
    y = F.when(label == 0, F.sin(angle)).otherwise(0.5 - F.sin(angle)) + noise * _normal(f"{seed}y", F.col("id"))
    return spark.range(rows).select("id", F.array(x, y, *[_normal(f"{seed}e{i}", F.col("id")) for i in range(extra)]).alias("v"), label.alias("label"))


def anisotropic(spark: SparkSession, rows: int, centres: int = 3, spread: float = 1.0, seed: int = 42) -> DataFrame:
    """(id, v, label): clouds in the plane, drawn out along one direction."""
    points = blobs(spark, rows, 2, centres, spread, seed=seed)
    x, y = F.col("v")[0], F.col("v")[1]
    return points.select("id", F.array(0.6 * x - 0.4 * y, -0.6 * x + 0.8 * y).alias("v"), "label")


def mixed(spark: SparkSession, rows: int, extra: int = 0, seed: int = 42) -> DataFrame:
    """(id, v, label): two clouds and, beside them, two rings of labels 2 and 3; extra numbers of noise."""
    half = rows // 2
    clouds = blobs(spark, half, 2, 2, spread=0.8, seed=seed)
    rings = circles(spark, rows - half, noise=0.05, factor=0.5, seed=seed + 1).select((F.col("id") + half).alias("id"), F.transform("v", lambda x: 5 * x + 5).alias("v"), (F.col("label") + 2).alias("label"))
    noise = [0.5 * _normal(f"{seed}m{i}", F.col("id")) for i in range(extra)]
    return clouds.unionByName(rings).withColumn("v", F.concat("v", F.array(*noise).cast("array<double>")))
