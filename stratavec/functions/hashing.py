"""Seeded hash functions: deterministic uniforms, locality-sensitive projections, bucket keys, probes, collision odds.

Projections are drawn by numpy from a seed on the driver and rounded to six decimals, so that SQL can state them; they
enter plans as one literal matrix."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vectors


def order_key(seed: int | str, *columns: Column | str) -> Column:
    """A string by which rows sort in an order fixed by the seed."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))


def uniform(seed: int | str, *columns: Column | str) -> Column:
    """A number in [0, 1) fixed by the seed and the columns."""
    return F.conv(F.substring(order_key(seed, *columns), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def _rounded(a: np.ndarray) -> np.ndarray:
    return np.round(a, 6)


@dataclass(frozen=True)
class HashFamily:
    """tables x hashes projections a of dim numbers, offsets b; metric euclidean, manhattan or cosine."""

    a: tuple[tuple[float, ...], ...]
    b: tuple[float, ...]
    tables: int
    hashes: int
    width: float
    metric: str

    @classmethod
    def draw(cls, dim: int, tables: int = 5, hashes: int = 10, width: float = 1.0, metric: str = "euclidean", seed: int = 42, kind: str = "random", ratio: float = 1.0) -> HashFamily:
        """kind: random, orthogonal or rotation; ignored for manhattan, which takes Cauchy numbers. ratio below 1 hashes
        a subset of the features drawn with replacement; its weights are put in their places, so that the hash is still
        one dot product."""
        if metric not in ("euclidean", "manhattan", "cosine"):
            raise ValueError(f"no hash for metric {metric!r}")
        rng = np.random.default_rng(seed)
        n = tables * hashes
        if metric == "manhattan":
            a = rng.standard_cauchy((n, dim))
        elif kind == "random":
            a = rng.standard_normal((n, dim))
        elif kind in ("orthogonal", "rotation"):
            a = np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-n // dim))])[:n]
        else:
            raise ValueError(f"unknown projection {kind!r}")
        if kind == "rotation" or metric == "cosine":
            a = a / np.linalg.norm(a, axis=1, keepdims=True)
        if ratio < 1:
            some = rng.integers(0, dim, max(1, int(dim * ratio)))
            dense = np.zeros((n, dim))
            np.add.at(dense, (slice(None), some), a[:, : len(some)])
            a = dense
        b = rng.uniform(0, width, n)
        return cls(tuple(map(tuple, _rounded(a).tolist())), tuple(_rounded(b).tolist()), tables, hashes, width, metric)

    def dots(self, v: Column) -> Column:
        return F.transform(F.lit([list(r) for r in self.a]), lambda p: vectors.dot(v, p))

    def shifted(self, v: Column) -> Column:
        """All hashes before they are cut into bins."""
        return self.dots(v) if self.metric == "cosine" else F.zip_with(self.dots(v), F.lit(list(self.b)), lambda x, b: x + b)

    def bins_of(self, shifted: Column, radius: float = 1.0) -> Column:
        """Such hashes as ints; radius widens the bins."""
        if self.metric == "cosine":
            return F.transform(shifted, lambda x: (x > 0).cast("int"))
        return F.transform(shifted, lambda x: F.floor(x / (self.width * radius)).cast("int"))

    def bins(self, v: Column, radius: float = 1.0) -> Column:
        """All hashes as ints, table after table."""
        return self.bins_of(self.shifted(v), radius)

    def bins_arrow(self, radius: float = 1.0):
        """The same as one matrix product per Arrow batch; for large tables, where a sum's order may not matter."""
        a, b, width, cosine = np.array(self.a).T, np.array(self.b), self.width * radius, self.metric == "cosine"

        @F.pandas_udf("array<int>")
        def hashed(v: pd.Series) -> pd.Series:
            x = np.stack(v.to_numpy()).astype(np.float64) @ a if len(v) else np.zeros((0, len(b)))
            return pd.Series(list(((x > 0) if cosine else np.floor((x + b) / width)).astype(np.int32)))

        return hashed

    def bins_rows(self, x: np.ndarray) -> np.ndarray:
        """The bins of the rows of x, bit by bit those of columns: sums run in the same order."""
        a, sums = np.array(self.a), np.zeros((len(x), len(self.b)))
        for i in range(x.shape[1]):
            sums += x[:, i, None] * a[:, i]
        if self.metric == "cosine":
            return (sums > 0).astype(np.int64)
        return np.floor((sums + np.array(self.b)) / self.width).astype(np.int64)

    def buckets(self, x: np.ndarray, probes: int = 1) -> np.ndarray:
        """(rows, tables * probes, 1 + hashes), 32-bit: table and bins of each row's buckets, and of their probes."""
        own = self.bins_rows(x).reshape(len(x), self.tables, 1, self.hashes)
        deltas = np.array(self.probe_deltas(probes), np.int64).reshape(-1, self.hashes)
        bins = np.abs(own - deltas) if self.metric == "cosine" else own + deltas
        table = np.broadcast_to(np.arange(self.tables).reshape(1, -1, 1, 1), (*bins.shape[:3], 1))
        return np.concatenate([table, bins], axis=3).astype(np.int32).reshape(len(x), -1, 1 + self.hashes)

    def table_bins(self, v: Column, table: int, radius: float = 1.0) -> Column:
        return F.slice(self.bins(v, radius), table * self.hashes + 1, self.hashes)

    def keys(self, v: Column, radius: float = 1.0) -> Column:
        """The bucket key of each table."""
        return vectors.let(self.bins(v, radius), self.keys_of)

    def keys_of(self, bins: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(self.tables - 1)), lambda t: bucket_key(F.slice(bins, t * self.hashes + 1, self.hashes)))

    def probe_deltas(self, probes: int) -> list[list[int]]:
        """Changes to one table's bins that are probed, none first: for cosine one and then two flipped bits, else steps
        of -1, 0, 1 in lexicographic order."""
        if self.metric == "cosine":
            order = [c for size in (1, 2) for c in itertools.combinations(range(self.hashes), size)]
            found = [[int(i in c) for i in range(self.hashes)] for c in order]
        else:
            found = (list(d) for d in itertools.product((-1, 0, 1), repeat=self.hashes) if any(d))
        return [[0] * self.hashes, *itertools.islice(found, max(probes - 1, 0))]

    def probe_keys(self, bins: Column, table: Column, probes: int) -> Column:
        """Keys of one table's bucket and its probes."""
        own = F.slice(bins, table * self.hashes + 1, self.hashes)
        change = (lambda x, d: F.abs(x - d)) if self.metric == "cosine" else (lambda x, d: x + d)
        return F.transform(F.lit(self.probe_deltas(probes)), lambda deltas: bucket_key(F.zip_with(own, deltas, change)))


def bucket_key(bins: Column) -> Column:
    return F.concat_ws("|", F.transform(bins, lambda x: x.cast("string")))


@dataclass(frozen=True)
class MultiWidth:
    """One set of projections, bins of many widths without offset."""

    a: tuple[tuple[float, ...], ...]
    widths: tuple[float, ...]

    @classmethod
    def draw(cls, dim: int, hashes: int, widths: list[float], kind: str = "normal", seed: int = 42) -> MultiWidth:
        """kind: normal with rows of length one, cauchy, or cauchy_mad with rows over their median absolute deviation."""
        if not widths or min(widths) <= 0 or hashes < 1 or dim < 1:
            raise ValueError("dim, hashes and widths must be positive")
        rng = np.random.default_rng(seed)
        if kind == "normal":
            a = rng.standard_normal((hashes, dim))
            a /= np.linalg.norm(a, axis=1, keepdims=True)
        elif kind in ("cauchy", "cauchy_mad"):
            a = rng.standard_cauchy((hashes, dim))
            if kind == "cauchy_mad":
                a /= np.median(np.abs(a - np.median(a, axis=1, keepdims=True)), axis=1, keepdims=True)
        else:
            raise ValueError(f"unknown projection {kind!r}")
        return cls(tuple(map(tuple, _rounded(a).tolist())), tuple(widths))

    def bins(self, v: Column) -> Column:
        """A struct with bins_0, bins_1, ... for the widths."""
        def floors(dots: Column) -> Column:
            binned = lambda w: F.transform(dots, lambda x: F.floor(x / w).cast("int"))
            return F.struct(*[binned(w).alias(f"bins_{k}") for k, w in enumerate(self.widths)])

        return vectors.let(F.transform(F.lit([list(r) for r in self.a]), lambda p: vectors.dot(v, p)), floors)


def collision_probability(distance: float, width: float, two_sided: bool = False) -> float:
    """Odds that two points at that distance share a bin of that width: the integral over t below width of
    phi(t / s) / s * (1 - t / width). Without two_sided only positive differences are counted, half of the odds."""
    if distance <= 0:
        return 1.0 if two_sided else 0.5
    r = width / distance
    half = math.erf(r / math.sqrt(2)) / 2 - (1 - math.exp(-r * r / 2)) / (r * math.sqrt(2 * math.pi))
    return 2 * half if two_sided else half


def collision_column(distance: Column, width: Column, steps: int = 200) -> Column:
    """The same by Simpson's rule, for columns."""
    h = width / steps
    value = lambda t: F.exp(-t * t / (2 * distance * distance)) / (distance * math.sqrt(2 * math.pi)) * (1 - t / width)
    weight = lambda i: F.when((i == 0) | (i == steps), 1).when(i % 2 == 1, 4).otherwise(2)
    return vectors.total(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: weight(i) * value(h * i))) * h / 3


def batch_id(data: Column, at: Column) -> Column:
    """batch_<16 hex digits of the SHA-256 of the data>_<time>."""
    return F.concat_ws("_", F.lit("batch"), F.substring(F.sha2(data, 256), 1, 16), F.date_format(at, "yyyyMMdd_HHmmss"))
