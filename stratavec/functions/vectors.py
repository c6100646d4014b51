"""Column builders for packed vectors, all in built-in functions. Elements are cast to double before arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def pack(*columns: str) -> Column:
    """Wide columns as one vector."""
    return F.array(*[F.col(c).cast("double") for c in columns])


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def squared_l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def cosine(a: Column, b: Column, least_norm: float = 1e-10) -> Column:
    """One minus the cosine; norms below least_norm count as that."""
    return 1 - dot(a, b) / (F.greatest(norm(a), F.lit(least_norm)) * F.greatest(norm(b), F.lit(least_norm)))


def clamped_cosine(a: Column, b: Column, slack: float = 1e-8) -> Column:
    """Cosine distance with the similarity kept slack away from -1 and 1."""
    similarity = dot(a, b) / (F.greatest(norm(a), F.lit(slack)) * F.greatest(norm(b), F.lit(slack)))
    return 1 - F.greatest(F.least(similarity, F.lit(1 - slack)), F.lit(slack - 1))


def hamming(a: Column, b: Column) -> Column:
    """The part of places that differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size(a)


METRICS: dict[str, Callable[[Column, Column], Column]] = {"euclidean": l2, "manhattan": l1, "cosine": cosine, "hamming": hamming}


def distance(metric: str) -> Callable[[Column, Column], Column]:
    try:
        return METRICS[metric]
    except KeyError:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}") from None


def normalized(v: Column) -> Column:
    return let(norm(v), lambda n: F.transform(v, lambda x: x / F.greatest(n, F.lit(1e-12))))


def sub_vector(v: Column, start: int, length: int) -> Column:
    return F.slice(v, start + 1, length)


def argmin(values: Column) -> Column:
    """The first place, from 0, of the least value."""
    return (F.array_position(values, F.array_min(values)) - 1).cast("int")


def features(v: Column, places: list[int]) -> Column:
    """The chosen places of v, repeats allowed."""
    return F.transform(F.lit(places), lambda i: v[i])
